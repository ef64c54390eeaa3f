"""Whole-text encoding with a public tokenizer file, chunk by chunk.

Both supported pre-tokenizers never join characters across the chunk borders
used here, so the ids of a text are the ids of its chunks in order, and a
chunk met before (most words) is a dictionary look-up instead of a BPE run.

Ids are those of the library's ``encode(text, add_special_tokens=False)`` with the
file as it is: the string of an added token inside a text gets that token's id. A
text that holds such a string is given to the library whole. With
``special_as_text=True`` these strings are ordinary text."""

from __future__ import annotations

import json
import re
import struct
import sys
import types

#: Unicode white space as the tokenizers' ``\\s`` has it (Python's also has \\x1c-\\x1f).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: letters and marks between which both pre-tokenizers always cut; apostrophes and
#: everything else stay inside a chunk
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
_P = "!-&(-/:-@\\[-`{-~"
#: byte-level BPE: an optional space with what follows; a run of blanks but its last
#: character when text follows; a single blank
_SPACED = re.compile(
    f"(?: |(?<![^{_WS}{_P}]))[{_L}]+(?![^{_WS}{_P}])| ?[{_P}]+(?=[{_L}{_WS}]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]"
)
#: BPE with word ends, white space dropped
_WORDS = re.compile(f"(?<![^ \n{_P}])[{_L}]+(?![^ \n{_P}])|[{_P}]+(?=[{_L} \n]|\\Z)|[^ \n]+")

#: chunks that are one pre-token: the BPE model can take them as they are
_ONE = re.compile(f" ?[{_L}]+")
#: byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

CACHE_CHUNKS = 500_000


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker (tasks share it)."""
    return sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__


def only_state_of(owner: str) -> None:
    """Drop what another operator's tasks left in the worker: a worker serves all operators
    of a session one after the other, and would hold the dictionaries of each."""
    state = worker_state()
    if state.get("owner") != owner:
        for name in [x for x in state if not str(x).startswith("__")]:
            del state[name]
        state["owner"] = owner


class _Known(dict):
    """Chunk -> ids, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= 64:  # longer ones are not worth keeping
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.lower = bool(spec["model"].get("end_of_word_suffix"))
        self.model = self.tokenizer.model if spec["model"]["type"] == "BPE" else None
        if self.lower:
            self.chunks = _WORDS.findall
        elif pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec["normalizer"]:
            self.chunks = _SPACED.findall
        else:
            self.chunks, self.model = (lambda text: [text]), None
        self.known = _Known(self._encode)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        # what the normaliser makes of a text may hold them too, so case doesn't count here
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda text: None

    def _encode(self, chunk: str) -> bytes:
        if self.model and len(chunk) <= 64 and _ONE.fullmatch(chunk):
            token = (chunk.lower() if self.lower else chunk).encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.model.tokenize(token)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for t in texts:
            if t and self.added(t):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
                continue
            out.append(b"".join(map(self.known.__getitem__, self.chunks(t or ""))))
            if len(self.known) > CACHE_CHUNKS:
                self.known.clear()
        return out


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once per worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    state = worker_state()
    if (path, special_as_text) not in state:
        state[path, special_as_text] = Encoder(path, special_as_text)
    return state[path, special_as_text]
