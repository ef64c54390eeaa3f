"""Declared schemas, column groups, thresholds and text catalogues.

Everything the risk rules depend on lives here so Catalyst sees literals it can
constant-fold, and so every threshold set stays separate (they differ on
purpose between the label, the plan, the charts, the indicators, the severity
matrix and the subject rules).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Student table
# ---------------------------------------------------------------------------

SUBJECTS = ["math", "physics", "chemistry", "english", "programming"]

STUDENT_SCHEMA = T.StructType(
    [
        T.StructField("student_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("semester", T.StringType()),
        T.StructField("gpa", T.DoubleType()),
        T.StructField("attendance_rate", T.DoubleType()),
        T.StructField("assignment_completion", T.DoubleType()),
        T.StructField("quiz_scores", T.DoubleType()),
        T.StructField("participation_score", T.DoubleType()),
        T.StructField("lms_activity", T.IntegerType()),
        T.StructField("late_submissions", T.IntegerType()),
        T.StructField("office_hours_visits", T.IntegerType()),
        T.StructField("study_group_participation", T.DoubleType()),
        T.StructField("previous_semester_gpa", T.DoubleType()),
    ]
    + [
        f
        for s in SUBJECTS
        for f in (
            T.StructField(f"{s}_attendance", T.DoubleType()),
            T.StructField(f"{s}_performance", T.DoubleType()),
        )
    ]
)

STUDENT_COLUMNS = [f.name for f in STUDENT_SCHEMA.fields]

# Columns an uploaded file must carry (validation order matters for messages).
REQUIRED_COLUMNS = [
    "student_id",
    "name",
    "gpa",
    "attendance_rate",
    "assignment_completion",
    "quiz_scores",
    "participation_score",
]

# Model features, in the order the feature vector is assembled.
FEATURE_COLUMNS = [
    "gpa",
    "attendance_rate",
    "assignment_completion",
    "quiz_scores",
    "participation_score",
    "lms_activity",
    "late_submissions",
    "office_hours_visits",
    "study_group_participation",
    "previous_semester_gpa",
]

SCORED_COLUMNS = ["risk_score", "risk_category", "risk_probability"]

CATEGORY_BY_SCORE = {0: "Low Risk", 1: "Medium Risk", 2: "High Risk"}
CATEGORIES = ["Low Risk", "Medium Risk", "High Risk"]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application for equal results.
# Thresholds, names, texts and their order are stated as given there.
# ---------------------------------------------------------------------------

# Rule label (2 = high, 1 = medium, 0 = low); each tier is OR-combined.
LABEL_HIGH = {"gpa": 2.5, "attendance_rate": 0.7, "assignment_completion": 0.6}
LABEL_MEDIUM = {"gpa": 3.0, "attendance_rate": 0.8, "assignment_completion": 0.75}

# Intervention-plan risk factors: (name, column, comparison, threshold, default
# used when the column is absent from the table).
PLAN_FACTORS = [
    ("Low GPA", "gpa", "<", 2.5, 4.0),
    ("Poor Attendance", "attendance_rate", "<", 0.7, 1.0),
    ("Incomplete Assignments", "assignment_completion", "<", 0.6, 1.0),
    ("Low Quiz Performance", "quiz_scores", "<", 60, 100),
    ("Low Participation", "participation_score", "<", 50, 100),
    ("Minimal LMS Engagement", "lms_activity", "<", 5, 0),
    ("Frequent Late Submissions", "late_submissions", ">", 3, 0),
    ("No Office Hours Visits", "office_hours_visits", "==", 0, 0),
]

# Dashboard / branch chart risk factors (first five plan factors, no defaults).
CHART_FACTORS = [
    ("Low GPA", "gpa", 2.5),
    ("Poor Attendance", "attendance_rate", 0.7),
    ("Incomplete Assignments", "assignment_completion", 0.6),
    ("Low Quiz Performance", "quiz_scores", 60),
    ("Low Participation", "participation_score", 50),
]

# Library indicator flags.
INDICATOR_THRESHOLDS = {
    "gpa_risk": ("gpa", 2.5),
    "attendance_risk": ("attendance_rate", 0.7),
    "assignment_risk": ("assignment_completion", 0.6),
    "engagement_risk": ("engagement_score", 0.3),
}

# Severity matrix: column -> (threshold for 1, threshold for 0.5).
SEVERITY_FACTORS = [
    ("gpa", 2.5, 3.0),
    ("attendance_rate", 0.7, 0.8),
    ("assignment_completion", 0.7, 0.8),
    ("quiz_scores", 60, 75),
    ("participation_score", 60, 75),
]

# Subject risk: attendance / performance thresholds for High, then Medium.
SUBJECT_HIGH = (0.6, 50)
SUBJECT_MEDIUM = (0.75, 65)
SUBJECT_NAMES = {
    "math": "Mathematics",
    "physics": "Physics",
    "chemistry": "Chemistry",
    "english": "English",
    "programming": "Programming",
}
SUBJECT_ADVICE = {
    "High Risk": "Immediate intervention needed",
    "Medium Risk": "Consider intervention",
    "Low Risk": "Continue monitoring",
}
SUBJECT_INTERVENTIONS = {
    "math": [
        "Extra math tutoring sessions",
        "Math problem-solving workshops",
        "Peer study groups for mathematics",
    ],
    "physics": [
        "Physics lab assistance",
        "Conceptual physics review sessions",
        "Physics problem-solving practice",
    ],
    "chemistry": [
        "Chemistry lab support",
        "Chemical equation balancing practice",
        "Chemistry concept reinforcement",
    ],
    "english": [
        "Writing skills improvement sessions",
        "Reading comprehension practice",
        "Grammar and vocabulary building",
    ],
    "programming": [
        "Coding practice sessions",
        "Algorithm and logic building",
        "Programming project assistance",
    ],
}

# Base recommendations per category, then the factor-specific additions.
BASE_RECOMMENDATIONS = {
    "High Risk": [
        "Immediate one-on-one meeting with academic advisor",
        "Mandatory tutoring sessions (2-3 times per week)",
        "Parent/guardian notification and involvement",
        "Academic probation monitoring",
        "Peer mentoring program assignment",
        "Regular check-ins with faculty advisor",
    ],
    "Medium Risk": [
        "Weekly check-ins with academic advisor",
        "Tutoring referral for specific subjects",
        "Study group participation encouragement",
        "Time management workshop attendance",
        "Office hours requirement (minimum 2 visits per month)",
    ],
    "Low Risk": [
        "Regular progress monitoring",
        "Optional study skills workshops",
        "Encouragement to maintain current performance",
        "Peer study group suggestions",
    ],
}
FACTOR_RECOMMENDATIONS = [
    ("Low GPA", "GPA recovery plan with specific grade targets"),
    ("Poor Attendance", "Attendance tracking and intervention protocol"),
    ("Incomplete Assignments", "Assignment completion support and deadline management"),
    ("Low Participation", "Participation improvement strategies and engagement techniques"),
]

# Timeline phases: phase -> lower-case keywords, per category (order kept).
TIMELINE_KEYWORDS = {
    "High Risk": [
        ("immediate", ["immediate", "mandatory"]),
        ("week_1", ["weekly", "tutoring"]),
        ("month_1", ["month", "workshop"]),
        ("ongoing", ["monitoring", "regular"]),
    ],
    "Medium Risk": [
        ("week_1", ["weekly"]),
        ("month_1", ["month", "workshop"]),
        ("ongoing", ["monitoring", "encouragement"]),
    ],
    # Low Risk: a single "ongoing" phase holding every recommendation.
}
# Timeline chart rows: phase -> (start day, duration days); others 30 / 30.
TIMELINE_START_DURATION = {"immediate": (0, 1), "week_1": (7, 7)}
TIMELINE_DEFAULT_START_DURATION = (30, 30)

FACTOR_SUCCESS_METRICS = [
    ("Low GPA", "GPA improvement of at least 0.3 points"),
    ("Poor Attendance", "Attendance rate above 85%"),
    ("Incomplete Assignments", "Assignment completion rate above 90%"),
    ("Low Participation", "Participation score improvement of 20+ points"),
]
CATEGORY_SUCCESS_METRICS = {
    "High Risk": [
        "No academic probation status",
        "Regular advisor meetings attended",
        "Tutoring sessions completed as scheduled",
    ],
    "Medium Risk": [
        "Maintained or improved current performance",
        "Completed recommended workshops",
        "Regular check-ins with advisor",
    ],
}

NEXT_STEPS = {
    "High Risk": [
        "Schedule immediate meeting with student",
        "Notify academic advisor and department head",
        "Set up tutoring appointments",
        "Create monitoring schedule",
    ],
    "Medium Risk": [
        "Schedule weekly check-in meeting",
        "Refer to appropriate support services",
        "Set up progress tracking",
    ],
    "Low Risk": [
        "Continue regular monitoring",
        "Provide encouragement and support",
        "Track progress indicators",
    ],
}

DURATION_DEFAULT = "4-8 weeks"
DURATION_LOW = "2-4 weeks"
NO_FACTORS_TEXT = "No specific risk factors identified"

# Email address pattern.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Range validation: (column, low, high, message), in check order.
RANGE_RULES = [
    ("gpa", 0, 4, "GPA values must be between 0 and 4"),
    ("attendance_rate", 0, 1, "Attendance rate must be between 0 and 1"),
    ("assignment_completion", 0, 1, "Assignment completion must be between 0 and 1"),
    ("quiz_scores", 0, 100, "Quiz scores must be between 0 and 100"),
]
MISSING_COLUMNS_PREFIX = "Missing required columns: "

# Branch alert bands on the average risk of high-risk students, and texts
# ("{branch}" is filled per row).
ALERT_CRITICAL = 80
ALERT_WARNING = 60
ALERT_CRITICAL_TEXT = "🚨 **CRITICAL:** {branch} has extremely high risk levels!"
ALERT_WARNING_TEXT = "⚠️ **WARNING:** {branch} requires immediate attention!"

# Banner per risk category on a student's page.
CATEGORY_BANNERS = {
    "High Risk": "🚨 **HIGH RISK STUDENT** - Immediate intervention required!",
    "Medium Risk": "⚠️ **MEDIUM RISK STUDENT** - Monitoring and support recommended",
    "Low Risk": "✅ **LOW RISK STUDENT** - Regular monitoring sufficient",
}

# Marker in front of a subject risk level (quoted in subject notifications).
SUBJECT_LEVEL_MARKERS = {"High Risk": "🔴 ", "Medium Risk": "🟡 ", "Low Risk": "🟢 "}

# Notification texts. {name}, {subject}, {risk}, {status_upper} are filled per row.
EMAIL_SUBJECT_WITH_SUBJECT = "Academic Support Update - {subject} - {status_title} Intervention"
EMAIL_SUBJECT_OVERALL = "Academic Support Update - {status_title} Intervention"

EMAIL_APPROVED_SUBJECT_HEAD = """
Dear {name},

We are writing to inform you that your academic support intervention for **{subject}** has been APPROVED by your academic advisor.

Subject: {subject}
Risk Level: {risk}
Status: {status_upper}

This means that we will be providing you with additional academic support specifically for {subject} to help you succeed in your studies.

"""
EMAIL_APPROVED_OVERALL_HEAD = """
Dear {name},

We are writing to inform you that your academic support intervention has been APPROVED by your academic advisor.

Risk Level: {risk}
Status: {status_upper}

This means that we will be providing you with additional academic support to help you succeed in your studies.

"""
EMAIL_APPROVED_PLAN_INTRO = "Your personalized support plan includes:\n"
EMAIL_APPROVED_TAIL = """
Please expect to hear from your academic advisor within the next 2-3 business days to discuss the next steps.

If you have any questions, please don't hesitate to contact your academic advisor or the student support office.

Best regards,
Academic Support Team
            """
EMAIL_DECLINED_SUBJECT = """
Dear {name},

We are writing to inform you that your academic support intervention for **{subject}** has been DECLINED at this time.

Subject: {subject}
Risk Level: {risk}
Status: {status_upper}

This means that we believe you are currently on track in {subject} and do not require additional intervention at this moment.

However, we will continue to monitor your academic progress in {subject}, and if you feel you need additional support, please don't hesitate to reach out to your academic advisor.

Best regards,
Academic Support Team
                """
EMAIL_DECLINED_OVERALL = """
Dear {name},

We are writing to inform you that your academic support intervention has been DECLINED at this time.

Risk Level: {risk}
Status: {status_upper}

This means that we believe you are currently on track and do not require additional intervention at this moment.

However, we will continue to monitor your academic progress, and if you feel you need additional support, please don't hesitate to reach out to your academic advisor.

Best regards,
Academic Support Team
                """

# Natural-language summary layout (8-space indented lines, stripped at the end).
SUMMARY_INDENT = "        "

# Generator distributions: column -> (kind, parameters).
GENERATOR_CHOICES = {
    "department": ["Computer Science", "Mathematics", "Physics", "Chemistry", "Biology", "Engineering"],
    "branch": [
        "Computer Science",
        "Information Technology",
        "Electronics",
        "Mechanical",
        "Civil",
        "Electrical",
        "Chemical",
        "Aerospace",
    ],
    "year": ["1st Year", "2nd Year", "3rd Year", "4th Year"],
    "section": ["A", "B", "C", "D", "E"],
    "semester": ["Fall 2024", "Spring 2024", "Summer 2024"],
}
GENERATOR_NUMERIC = [
    ("gpa", "normal", (3.2, 0.8), (0.0, 4.0)),
    ("attendance_rate", "beta", (8, 2), None),
    ("assignment_completion", "beta", (7, 3), None),
    ("quiz_scores", "normal", (75, 15), (0.0, 100.0)),
    ("participation_score", "normal", (70, 20), (0.0, 100.0)),
    ("lms_activity", "poisson", (15,), None),
    ("late_submissions", "poisson", (2,), None),
    ("office_hours_visits", "poisson", (3,), None),
    ("study_group_participation", "beta", (3, 7), None),
    ("previous_semester_gpa", "normal", (3.1, 0.9), (0.0, 4.0)),
    ("math_attendance", "beta", (8, 2), None),
    ("math_performance", "normal", (75, 15), (0.0, 100.0)),
    ("physics_attendance", "beta", (7, 3), None),
    ("physics_performance", "normal", (72, 18), (0.0, 100.0)),
    ("chemistry_attendance", "beta", (7, 3), None),
    ("chemistry_performance", "normal", (74, 16), (0.0, 100.0)),
    ("english_attendance", "beta", (8, 2), None),
    ("english_performance", "normal", (78, 12), (0.0, 100.0)),
    ("programming_attendance", "beta", (6, 4), None),
    ("programming_performance", "normal", (70, 20), (0.0, 100.0)),
]

# Model hyper-parameters.
GBT_PARAMS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1}
RF_PARAMS = {"numTrees": 100, "maxDepth": 10}
SEED = 42
TEST_FRACTION = 0.2
CV_FOLDS = 5
