"""Token counts of whole texts by a public tokenizer.

Only lengths leave the workers. A text is cut at ASCII white space, where this tokenizer always ends a
token (its pre-tokenizer drops white space and no rule spans it; ``safe_to_split`` checks that from the
file). A piece of more than ``LONG`` characters without white space is cut further where the pre-tokenizer ends a word in any
case: beside ASCII digits, and between a letter and a mark, but not inside special strings. Only a longer run of
letters alone, or of marks alone, reaches the library whole, as it is one word to it. Each worker encodes a piece once a batch
and keeps a bounded table of counts; batches to the library are closed by bytes.

Defined results: null counts as empty, with 0 bytes and 0 tokens; special strings inside texts are taken
as the library does by default; no truncation or padding; null ids stay null and repeated rows are separate rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

#: Entries of a worker's table of counts, the longest piece kept there, bytes a batch of the library.
CACHE, CACHE_CHARS, BATCH_BYTES = 400_000, 40, 1 << 20
LIMIT, LONG = 2048, 1 << 16
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def safe_to_split(path: str) -> bool:
    """Whether white space always ends a token: white space is dropped by a ``Split`` whose pattern cannot
    match across it, nothing is put before a text, and there is no post-processor."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = next((s for s in steps if s.get("type") == "Split"), None)
    level = next((s for s in steps if s.get("type") == "ByteLevel"), {})
    pattern = (split or {}).get("pattern", {}).get("Regex", "")
    return bool(split and split.get("invert") and split.get("behavior") == "Removed" and "\\s+" not in pattern and "[^\\s" in pattern and not level.get("add_prefix_space") and not level.get("use_regex") and not t.get("post_processor") and not any(a["lstrip"] or a["rstrip"] or " " in a["content"] for a in t["added_tokens"]))


#: The words of the pre-tokenizer for which ``cut`` is safe: runs of letters, single digits, runs of marks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BOUND = re.compile(r"(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^\W\d_])(?=[!-/:-@\[-`{-~。、！？，．；：「」])")


def word_pattern(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or []
    return next((s["pattern"].get("Regex", "") for s in steps if s.get("type") == "Split"), "")


def cut(text: str, special: frozenset[str], most: int = LONG) -> list[str]:
    """Pieces of ``most`` characters or a little more, up to the next place where a word ends; ``special``: pairs of
    characters that are beside each other in special strings."""
    out, at = [], 0
    while len(text) - at > most:
        found = _BOUND.finditer(text, at + most)
        end = next((k for m in found if (k := m.start()) > at and text[k - 1 : k + 1] not in special), None)
        if end is None:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class Counter:
    """Counts tokens of texts. One for each worker process and file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.split = safe_to_split(path)
        self.words = word_pattern(path) == WORDS
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = frozenset(t[k : k + 2] for t in contents for k in range(len(t) - 1))
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                out += map(len, self.encode(batch, add_special_tokens=False))
                batch, size = [], 0
        if batch:
            out += map(len, self.encode(batch, add_special_tokens=False))
        return out

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.lengths(texts)
        known, pieces = self.known, [_ascii_split(t) for t in texts]
        if self.words:
            pieces = [[q for p in ps for q in (cut(p, self.special) if len(p) > LONG else (p,))] if len(t) > LONG else ps for t, ps in zip(texts, pieces, strict=True)]
        new = list({p for ps in pieces for p in ps if p not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({p for ps in pieces for p in ps})
        fresh = dict(zip(new, self.lengths(new), strict=True))
        known.update(fresh)
        out = [sum(map(known.__getitem__, ps)) for ps in pieces]
        if len(known) > CACHE:
            known.clear()
        else:
            for p in new:
                if len(p) > CACHE_CHARS:
                    del known[p]
        return out


def _ascii_split(text: str) -> list[str]:
    """Cut at ASCII white space only; other kinds stay inside the pieces, for the library."""
    if text.isascii() and not _CONTROLS.search(text):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text.split(" ")


#: str.split() also cuts at these.
_CONTROLS = re.compile(r"[\x1c-\x1f]")
_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _batches(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    path = vocabulary or vocabulary_path()

    def count(batches):
        import pyarrow as pa

        c = counter(path)
        for b in batches:
            out: list[int] = []
            for texts in _batches([x or "" for x in b.column(1).to_pylist()]):
                out += c.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    t = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    return t.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
