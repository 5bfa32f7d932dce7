"""Secret scans: three fixed patterns, and strings in sensitive context that a primed zstandard can't compress."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import SLICE

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run has no other start that is long enough
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words before a string that make its place sensitive.
CONTEXT = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private", "credential", "bearer",
           "authorization", "signature", "client_id", "session", "cookie")
CONTEXT_RE = re.compile("|".join(map(re.escape, CONTEXT)), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHARED = 16  # the least length of a candidate
#: Identifiers and phrases of code and configuration, raw content of the dictionary.
IDENTIFIERS = ("abstract argument array async await boolean buffer callback catch class client config connection const constructor container context controller "
               "database default define delete description element environment example exception export extends false filename filter finally float format "
               "function handler header implements import include index instance integer interface iterator library listener localhost location manager "
               "message method middleware module namespace null number object operator option override package parameter password path pattern placeholder "
               "prefix private process production property protected protocol public query readonly reference register repository request resource response "
               "result return router runtime schema secret select self server service session setting signature source static status string struct suffix "
               "switch template test throw timeout token transaction true type undefined union update upload user username utility value variable vector "
               "version virtual void warning while workspace wrapper your_api_key_here changeme xxxxxxxxxxxxxxxx ################ 0000000000000000 "
               "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ---------------- ================ ________________")


def without(known: str, new: str) -> str:
    """The known text with blanks for what it shares with `new` over SHARED or more characters."""
    parts = {new[i:i + SHARED] for i in range(len(new) - SHARED + 1)}
    out, upto = [], 0
    for i in range(len(known)):
        if known[i:i + SHARED] in parts:
            upto = i + SHARED
        out.append(" " if i < upto else known[i])
    return "".join(out)


class Novelty:
    """Bytes that a string adds to the compressed text around it, under a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, around: int = 512):
        words = identifiers.split()
        styles = [f(w) for f in (str, str.upper, str.title) for w in words]
        styles += [f"{a}_{b} {a}{b.title()} {a}-{b}" for a, b in zip(words, words[1:])]
        data = " ".join(styles).encode()
        self.zip = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.around = around

    def marginal(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes per byte of text[start:end]. The text beside it counts as known, without
        what repeats the string there: one that stands several times is as novel as one that stands once."""
        reach = self.around + end - start  # a repetition over the edge of the window is seen whole
        left, right = (without(part, text[start:end]) for part in (text[max(0, start - reach):start], text[end:end + reach]))
        known = (left[max(0, len(left) - self.around):] + "\n" + right[:self.around]).encode("utf-8", "replace")
        new = text[start:end].encode("utf-8", "replace")
        return (len(self.zip.compress(known + b"\n" + new)) - len(self.zip.compress(known + b"\n"))) / len(new)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost non-overlapping per kind."""
    low = text.lower()
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(h in low for h in ASSIGN_HINTS) else []
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def novel_spans(text: str, taken: Sequence[tuple[int, int, int]], novelty: Novelty, least: float, near: int) -> list[tuple[int, int, int]]:
    """Strings within `near` characters after a sensitive word, outside `taken`, that add at least `least` bytes per byte."""
    out, done = [], 0
    low = text.lower()
    if not any(c in low for c in CONTEXT):
        return out
    taken = sorted(taken)
    for word in CONTEXT_RE.finditer(text):
        for m in CANDIDATE.finditer(text, max(done, word.end())):
            if m.start() > word.end() + near:
                break
            done = m.end()
            if not any(s < m.end() and m.start() < e for s, e, _ in taken) and novelty.marginal(text, m.start(), m.end()) >= least:
                out.append((m.start(), m.end(), 3))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = 0.7, near: int = 40, identifiers: str = IDENTIFIERS) -> DataFrame:
    """(id, found): an array of (start, end, kind, value) per row, in code points, end exclusive, by start and kind.

    Kinds assign, access and hex are the fixed patterns over the whole text; novel adds strings of 16 or more
    signs that follow a sensitive word and that the text around them and the identifiers don't explain: the
    marginal compressed size is at least `least` bytes per byte, where repetitions of the string itself don't
    count as text around it. Null and empty texts have no spans. Repeated
    rows come out alike, an empty table gives no rows, other columns are not read. Texts of any length are
    read whole; the compressor sees a window on each side of a string.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    schema = T.StructType([rows.schema["id"], T.StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                b, out = batch.slice(s, SLICE), []
                for t in b.column("text").to_pylist():
                    t = t or ""
                    spans = base_spans(t)
                    spans += novel_spans(t, spans, novelty, least, near)
                    out.append([{"start": a, "end": e, "kind": KINDS[k], "value": t[a:e]} for a, e, k in sorted(spans, key=lambda x: (x[0], x[2]))])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, arrow)], ["id", "found"])

    return rows.mapInArrow(run, schema)
