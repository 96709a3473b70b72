"""Token counts of the sections of documents by offset-mapped attribution.

Each document is encoded once, as a whole. The bytes of its tokens give every token a span of
characters, and a merge of the sorted token starts with the sorted section starts attributes tokens to
sections. These are lines (each with the line end that closes it) or, with ``sections``, the spans given in a column of
arrays of (start, end) in characters, such as those of :func:`with_fields`. A token that reaches over a boundary goes
to one section by ``rule``: ``first`` (that of its first character), ``last``, or ``most`` (that with
most of its characters, the earlier one in a tie). So the sections' counts add up to the document's; tokens between
given sections are counted in a row whose section is null, if there is such a place.

Nothing is shuffled: a document's tokens live and end in one task. The encoder's pattern can't hold a run of white space
of any length, so longer runs than ``LONG_GAP`` are cut out and encoded as the one piece that they are; texts of
any length pass.

Result: a row for each section: doc_id, section, start, end (characters), n_tokens, n_crossing (of these,
tokens that reach into another section). Defined cases: a null or empty text has one empty section with
no tokens (if sections are given, those given, empty); a line end at the very end opens no further section; given
sections are taken in order of their starts, cut to the text, and where two overlap the common part is the earlier one's;
null spans and spans with a null end are left out; repeated rows give repeated rows; ties of ``most`` go to the earlier
section; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import documents, ship, text_of

#: Where the vocabulary files of public tokenizers are, and which is used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern's ``\s`` has it, and the length from which a run of it is encoded apart.
BLANK, LONG_GAP = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1000
GAP = re.compile(f"[{BLANK}]{{{LONG_GAP},}}")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder and the number of bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(coder, text: str) -> list[int]:
    """Tokens of a whole text. A run of white space is one piece without its last character, which may belong to what follows."""
    out: list[int] = []
    at = 0
    for m in GAP.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += coder.encode_ordinary(text[at : m.start()])
        out += coder._encode_single_piece(text[m.start() : end].encode())
        at = end
    return out + coder.encode_ordinary(text[at:]) if out else coder.encode_ordinary(text)


def line_starts(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)]])


def parted(spans: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts that given spans make of a text, and the number of each part's span (-1 between spans)."""
    begin, own, at = [], [], 0
    for k, (a, b) in enumerate(spans):
        a, b = min(max(a, at), length), min(b, length)
        if a > at:
            begin.append(at)
            own.append(-1)
        begin.append(a)
        own.append(k)
        at = max(a, b)
    if at < length or not begin:
        begin.append(at)
        own.append(-1)
    return np.array(begin, np.int64), np.array(own, np.int64)


def attribute(text: str, path: str, rule: str = "first", spans: list[tuple[int, int]] | None = None) -> dict[str, np.ndarray]:
    coder, sizes = encoding(path)
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(sizes[np.array(encode(coder, text), np.int64)])
    # The number of characters before each byte and at the end.
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    # Characters that hold a token's first and last byte.
    first = chars[np.concatenate([[0], ends[:-1]]) + 1] - 1 if len(ends) else ends
    last = chars[ends] - 1 if len(ends) else ends
    begin, part = (chars[line_starts(data)], None) if spans is None else parted(spans, int(chars[-1]))
    # Empty parts stand before the one that starts at the same place, so searching from the right never meets them.
    a, b = (np.searchsorted(begin, x, "right") - 1 for x in (first, last))
    own = a
    if rule == "last":
        own = b
    elif rule == "most":
        cut = begin[b]
        own = np.where((b == a + 1) & (last + 1 - cut > cut - first), b, a)
        for t in np.flatnonzero(b > a + 1):
            edges = [first[t], *begin[a[t] + 1 : b[t] + 1], last[t] + 1]
            own[t] = a[t] + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(f"rule is first, last or most, not {rule}")
    n = len(begin)
    stop, tokens, crossing = np.append(begin[1:], chars[-1]), np.bincount(own, minlength=n), np.bincount(own[a != b], minlength=n)
    if part is None:
        return {"section": np.arange(n), "start": begin, "end": stop, "n_tokens": tokens, "n_crossing": crossing}
    given = part >= 0
    out = {"section": part[given], "start": begin[given], "end": stop[given], "n_tokens": tokens[given], "n_crossing": crossing[given]}
    if (~given).any() and chars[-1]:
        rest = {"section": -1, "start": 0, "end": chars[-1], "n_tokens": tokens[~given].sum(), "n_crossing": crossing[~given].sum()}
        out = {c: np.append(v, rest[c]) for c, v in out.items()}
    return out


def with_fields(docs: DataFrame, fields: list[str], between: str = "\n") -> DataFrame:
    """``doc_id``, the text of several columns joined in order (null is empty), and their spans in it as ``sections``."""
    texts = [F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")) for c in fields]
    at, spans = F.lit(0), []
    for t in texts:
        spans.append(F.struct(at.cast("int").alias("start"), (at + F.char_length(t)).cast("int").alias("end")))
        at = at + F.char_length(t) + len(between)
    return docs.select("doc_id", F.concat_ws(between, *texts).alias("text"), F.array(*spans).alias("sections"))


def section_tokens(docs: DataFrame, rule: str = "first", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, sections: str | None = None) -> DataFrame:
    """``sections``: a column of arrays of (start, end); none means lines. The vocabulary's file is sent to the executors."""
    spark = docs.sparkSession
    ship(spark)
    spark.sparkContext.addFile(f"{tokenizers}/{vocabulary}")
    names = ("start", "end", "n_tokens", "n_crossing")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < len(texts):
                found, parts = [], 0
                i = at
                while at < len(texts) and at - i < 256 and parts < 1 << 18:
                    spans = None
                    if sections is not None:
                        given = batch.column("sections")[at].as_py() or []
                        spans = sorted((x["start"], x["end"]) for x in given if x and x["start"] is not None and x["end"] is not None)
                    found.append(attribute(texts[at].as_py() or "", path, rule, spans))
                    parts += len(found[-1]["start"])
                    at += 1
                n = np.array([len(x["start"]) for x in found])
                section = np.concatenate([x["section"] for x in found]).astype(np.int32)
                cols = [np.concatenate([x[c] for x in found]).astype(np.int64) for c in names]
                yield pa.RecordBatch.from_arrays([ids.slice(i, at - i).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(section, mask=section < 0), *map(pa.array, cols)], ["doc_id", "section", *names])

    narrow = docs.select("doc_id", text_of(docs).alias("text"), *([] if sections is None else [F.transform(sections, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))).alias("sections")]))
    return narrow.mapInArrow(count, f"doc_id {dict(narrow.dtypes)['doc_id']}, section int, start long, end long, n_tokens long, n_crossing long")


def op1_token_counts(spark, sf_dir):
    return section_tokens(documents(spark, sf_dir))
