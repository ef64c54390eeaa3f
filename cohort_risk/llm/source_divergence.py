"""Source divergence audit: how far the term frequencies of a language's sources lie
apart, from term counts that a token-start pointer sort makes.

1. Inside a task the texts of a shard lie end to end in an Arrow buffer. Every
   place where a term starts is a pointer (numpy, no string is made).
2. A stable multikey quicksort orders the pointers by their terms, eight bytes at a
   time: slices are parted by a pivot into less, equal and greater, and only the
   equal part looks at the next eight bytes; small slices are ordered at once.
3. Each run of equal terms gives occurrences and documents per (lang, source).
   A shard holds at most ``SHARD_BYTES`` of text; a longer text is several slices,
   whose terms are counted once as a document of it.
4. Spark adds the runs of all shards up and keeps the terms of a language that
   occur in enough of its documents (rows).
5. Smoothed shares per billion of every group (lang, source) and every language
   are compared by a whole-number chi-square distance: with each other source of
   the language over all kept terms (part ``pair``) and, term by term, of a group
   with its language (part ``term``, the largest ``top``).

Pairs need no row per source pair and absent term: f depends on a term only
through its two counts, so terms that one source lacks enter by the other's
histogram of counts, terms that both lack by their number, and only terms that
two sources share are joined. All sums are of integers and exact.

Defined results: null text, lang and source are read as ''; rows that share an id
are documents of their own; a group without terms still has its rows (``pair``),
with value 0 where its language keeps no term; ties go to the smaller item (UTF-8);
other columns aren't read; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
SHARD_BYTES = 8 << 20
SMALL = 4096

# Terms are runs of letters A-Z, a-z and bytes of non-ASCII characters.
_IS_TERM = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_FIRST_BYTES = np.array([0, *((1 << 64) - (1 << 64 - 8 * n) for n in range(1, 9))], np.uint64)


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the places of ``starts`` by term, pointers of equal terms in their
    given order, and a mark at the first of every run. ``data`` ends with eight zeros;
    terms hold no zero byte and have at least one byte."""
    words = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))  # the eight bytes at every place

    def keys(part: np.ndarray, depth) -> np.ndarray:
        left = np.clip(lengths[part] - depth, 0, 8)
        return words[np.minimum(starts[part] + depth, len(words) - 1)].astype(np.uint64) & _FIRST_BYTES[left]

    order, first = np.arange(len(starts)), np.zeros(len(starts), bool)
    now = keys(order, 0) if len(starts) else np.zeros(0, np.uint64)
    stack = [(0, len(starts), 0)] if len(starts) else []
    while stack:
        lo, hi, depth = stack.pop()
        part, key = order[lo:hi], now[lo:hi]
        if hi - lo > small:
            some = np.sort(key[:: max(1, (hi - lo) // 9)])
            pivot = some[len(some) // 2]
            less, same = key < pivot, key == pivot
            more = ~(less | same)
            n_less, n_same = int(less.sum()), int(same.sum())
            middle = part[same]
            order[lo:hi], now[lo:hi] = np.concatenate((part[less], middle, part[more])), np.concatenate((key[less], key[same], key[more]))
            a, b = lo + n_less, lo + n_less + n_same
            if n_less:
                stack.append((lo, a, depth))
            if b < hi:
                stack.append((b, hi, depth))
            if int(pivot) & 0xFF:  # no term of the equal part ends here
                now[a:b] = keys(middle, depth + 8)
                stack.append((a, b, depth + 8))
            else:
                first[a] = True
            continue
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        edge = np.concatenate(([True], key[1:] != key[:-1]))
        open_ = np.flatnonzero(key & np.uint64(0xFF))  # terms that go on
        while len(open_):
            # runs that go on are ordered by their next bytes, all together
            depth += 8
            run, following = np.cumsum(edge)[open_], keys(part[open_], depth)
            by = np.lexsort((following, run))
            part[open_], following = part[open_[by]], following[by]
            edge[open_] |= np.concatenate(([True], (following[1:] != following[:-1]) | (run[1:] != run[:-1])))
            open_ = open_[(following & np.uint64(0xFF)) != 0]
        order[lo:hi], first[lo:hi] = part, edge
    return order, first


def slices(sizes: np.ndarray, limit: int):
    """(first row, end row) of shards of at most ``limit`` bytes, or of one row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def pointers(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the terms of ``raw``; none reaches across ``edges``."""
    term = _IS_TERM[raw]
    before, after = np.empty_like(term), np.empty_like(term)
    before[:1], before[1:] = False, term[:-1]
    after[-1:], after[:-1] = False, term[1:]
    inner = edges[(edges > 0) & (edges < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(term & ~before)
    return starts, np.flatnonzero(term & ~after) + 1 - starts


def _runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, group: np.ndarray, groups: int):
    """(terms, run, group, occurrences, documents) of the pointers; ``doc`` and ``group`` by pointer."""
    data = np.concatenate((_LOWER[raw], np.zeros(8, np.uint8)))
    order, first = multikey_quicksort(data, starts, lengths)
    run, doc, group = np.cumsum(first) - 1, doc[order], group[order]
    fresh = first | np.concatenate(([True], doc[1:] != doc[:-1]))  # the order is stable, so a run's documents ascend
    cell, place = np.unique(run * groups + group, return_inverse=True)
    heads = order[first]
    lo = starts[heads]
    text = data.tobytes()
    terms = [text[a:b] for a, b in zip(lo.tolist(), (lo + lengths[heads]).tolist(), strict=True)]
    return terms, cell // groups, cell % groups, np.bincount(place, minlength=len(cell)), np.bincount(place, weights=fresh, minlength=len(cell)).astype(np.int64)


def _count(shard_bytes: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(names, terms, run, group, n, docs):
        every = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(run))
        of = pa.array(group)
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in names], pa.string()).take(of), pa.array([g[1] for g in names], pa.string()).take(of), every, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=schema)

    def long_text(raw, names, group):
        """One text in slices; a term counts as a document of it in the first slice only."""
        seen: set[bytes] = set()
        at = 0
        while at < len(raw):
            end = min(at + shard_bytes, len(raw))
            while end < len(raw) and _IS_TERM[raw[end]] and _IS_TERM[raw[end - 1]]:
                end += 1
            starts, lengths = pointers(raw[at:end], np.zeros(0, int))
            if len(starts):
                terms, run, _, n, _ = _runs(raw[at:end], starts, lengths, np.zeros(len(starts), int), np.zeros(len(starts), int), 1)
                docs = [t not in seen for t in terms]
                seen.update(terms)
                yield rows(names, terms, run, np.full(len(run), group), n, np.array(docs, np.int64))
            at = end

    def count(batches):
        for b in batches:
            langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault(g, len(number)) for g in zip(langs, sources, strict=True)], np.int64)
            names = list(number)
            if names:  # every group has a row, also without terms
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string()), pa.nulls(len(names), pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([0] * len(names), pa.int64())], schema=schema)
            wide = pa.types.is_large_string(texts.type)
            _, places, data = texts.buffers()
            at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            for lo, hi in slices(np.diff(at), shard_bytes):
                raw, edges = whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                if hi - lo == 1 and len(raw) > shard_bytes:
                    yield from long_text(raw, names, group[lo])
                    continue
                starts, lengths = pointers(raw, edges)
                if len(starts):
                    doc = np.searchsorted(edges, starts, "right") - 1
                    yield rows(names, *_runs(raw, starts, lengths, doc, group[lo:hi][doc], len(names)))

    return count


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents); term is null in one
    more row of every group."""
    read = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = C.map_arrow(df.select(*read), _count(shard_bytes), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / total), exact at every size."""
    fits = n < (2**63 - 1) // scale - 1
    small = F.call_function("div", (n + 1) * F.lit(scale).cast("long"), total)
    large = F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)"), total.cast("decimal(19,0)"))
    return 1 + F.when(fits, small).otherwise(large)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most scale + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank."""
    counts = C.written(term_counts(df, text_col, lang_col, source_col), "divergence-counts")
    of_term = Window.partitionBy("lang", "term")  # a row per source
    rows = counts.filter("term IS NOT NULL").select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("in_lang"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("once"),
    )
    rows = C.written(rows.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")

    langs = rows.groupBy("lang").agg(F.count_if("once").alias("terms"), F.sum("n").alias("n_lang"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("present"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    # at least 1 where a language keeps no term, and nothing is divided by it there
    total = F.greatest(F.col("n") + F.col("terms"), F.lit(1))
    groups = groups.select("lang", "source", "terms", "present", total.alias("total"), (F.col("n_lang") + F.col("terms")).alias("lang_total"))
    groups = C.written(groups.withColumn("absent", share(F.lit(0).cast("long"), F.col("total"))), "divergence-groups")

    rated = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "absent", share(F.col("n"), F.col("total")).alias("p"), share(F.col("in_lang"), F.col("lang_total")).alias("q"))
    terms = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    def side(frame, name, *cols):
        return frame.select("lang", *[F.col(c).alias(f"{name}_{c}") for c in cols])

    # pairs of a language's sources: the rows of the result
    pairs = side(groups, "g", "source", "absent", "present").join(side(groups.withColumnRenamed("terms", "all"), "h", "source", "absent", "present", "all"), "lang")
    pairs = pairs.filter("g_source <> h_source")
    pair = ["lang", "g_source", "h_source"]
    f = lambda g, h: distance(F.col(g), F.col(h))

    seen = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))  # equal counts have equal shares
    only_g = seen.withColumnRenamed("source", "g_source").join(pairs, ["lang", "g_source"]).groupBy(*pair).agg(F.sum(F.col("k") * f("p", "h_absent")).alias("only_g"))
    only_h = seen.withColumnRenamed("source", "h_source").join(pairs, ["lang", "h_source"]).groupBy(*pair).agg(F.sum(F.col("k") * f("g_absent", "p")).alias("only_h"))
    left = rated.select("lang", "term", F.col("source").alias("g_source"), F.col("p").alias("g"), F.col("absent").alias("g0"))
    right = rated.select("lang", "term", F.col("source").alias("h_source"), F.col("p").alias("h"), F.col("absent").alias("h0"))
    # a shared term was counted in both histograms as if the other source lacked it
    both = C.split_join(left, right, ["lang", "term"]).filter("g_source <> h_source")
    both = both.groupBy(*pair).agg(F.count("*").alias("shared"), F.sum(f("g", "h") - f("g", "h0") - f("g0", "h")).alias("both"))
    values = pairs.join(only_g, pair, "left").join(only_h, pair, "left").join(both, pair, "left").na.fill(0)
    neither = F.col("h_all") - F.col("g_present") - F.col("h_present") + F.col("shared")
    value = F.when(F.col("h_all") > 0, F.col("only_g") + F.col("only_h") + F.col("both") + neither * f("g_absent", "h_absent")).otherwise(F.lit(0))
    values = values.select("lang", F.col("g_source").alias("source"), F.lit("pair").alias("part"), F.col("h_source").alias("item"), value.cast("long").alias("value"))
    values = values.withColumn("rank", F.row_number().over(ranked))
    return values.unionByName(terms)
