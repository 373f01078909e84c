"""Token counts with a whole-token shortcut.

Offline, once per vocabulary, three facts are proved by asking the tokenizer itself:
- which vocabulary strings, standing alone as a pre-token, encode to that one token;
- that no vocabulary string has the space mark after another character, so no merge crosses the place
  before a run of spaces, and texts may be cut there;
- that no vocabulary string of several characters holds a line feed, so texts may be cut at each.
A text is then cut into pre-tokens. Those proved to be one token count 1 without encoding; only the rest
are merged, by the tokenizer, and a bounded table remembers the commonest results. A vocabulary for which
the second or third fact fails is encoded whole.

Defined results: null text counts as empty, an empty text has no tokens; repeated rows have equal counts; an
empty table gives an empty result; columns besides id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import textkernel as tk
from hyperloom.llm.shared import small_batches, table, text_column

MARK = "▁"
LIMIT = 4096
#: Merged pre-tokens remembered by a worker, and the longest one kept.
REMEMBERED, LONGEST = 400_000, 48
_PARTS = re.compile(r" *[^ ]+| +")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter(dict):
    """Tokens of a text. As a table: pre-token (without its space) to its count."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.cuts = self._cuts_hold(pieces)
        self.bare: dict[str, int] = {}
        self.whole = self._whole_tokens(pieces) if self.cuts else {}
        self.update(self.whole)

    def _cuts_hold(self, pieces: list[str]) -> bool:
        """The second and third fact, and that a line feed and the mark encode as supposed."""
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        feeds = any("\n" in p and len(p) > 1 for p in pieces)
        encode = self.model.encode
        plain = encode("a b") == encode(f"a{MARK}b") and encode("a\nb") == encode("a") + encode("\nb")[1:] and len(encode(" a")) == len(encode("a")) + 1
        return plain and not (crossing or feeds)

    def _whole_tokens(self, pieces: list[str]) -> dict[str, int]:
        """The first fact: vocabulary strings with one leading mark that encode alone as one token."""
        bodies = [p[1:] for p in pieces if p[:1] == MARK and len(p) > 1 and MARK not in p[1:] and "\n" not in p]
        return {b: 1 for b, ids in zip(bodies, self.model.encode(bodies, num_threads=1), strict=True) if len(ids) == 1}

    def _after_feed(self, text: str) -> int:
        """Tokens of a cut part, as it stands: after a line feed no space is put before it."""
        return len(self.model.encode("\n" + text)) - 2

    def _bare(self, word: str) -> int:
        if (n := self.bare.get(word)) is None:
            n = self._after_feed(word)
            if len(word) <= LONGEST:
                if len(self.bare) >= REMEMBERED // 4:
                    self.bare.clear()
                self.bare[word] = n
        return n

    def __missing__(self, word: str) -> int:
        if "\n" in word:
            first, *rest = word.split("\n")
            head = self[first] if first else self._after_feed(" ")
            return head + sum(1 + (self._bare(x) if x else 0) for x in rest)
        n = self._after_feed(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.whole)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        total = 0
        for k, line in enumerate((" " + text).split("\n")):
            total += k > 0
            for part in _PARTS.findall(line):
                if part[0] == " " and part[1:2] not in ("", " "):
                    total += self[part[1:]]
                else:
                    total += self._after_feed(part) if part[0] == " " else self._bare(part)
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. path: a piece model that executors can read."""
    small_batches(docs.sparkSession)
    path = path or model_path()

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            sizes = tk.arrow_bytes(batch.column(1))[1]
            counts = [tokens.count(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes[1:] - sizes[:-1]), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
