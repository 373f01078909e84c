"""Secret scans with DataFrame functions only.

Base rules give assignments, access keys and hexadecimal runs. Further spans come from two character
Markov models, of random strings and of ordinary identifiers: the log-likelihood ratio of a candidate
token under them, summed over its character pairs. Both are counted from labelled samples, generated random
strings and identifiers; half of the ordinary model is the words of all documents. The ratios of all
character pairs are a fixed table of len(ALPHABET)**2 numbers.

Candidates are runs of ALPHABET in what the base spans leave of a text, so a base span cuts a run and what
is left of it on either side is scored by itself.

Spans are in code points. A long text is cut into parts of about PART characters, each after a character
that no pattern takes, so no match crosses a cut and the work grows with the text, however many matches it
has. Within a part, positions come from the lengths of matches and of what lies between them.

Defined results: null text counts as empty and has no spans; equal rows have equal results; an empty table
gives an empty result (and a model from the generated samples alone); columns besides id and text,
whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.shared import table, text_column

# Fixed patterns of the base rules.
ASSIGN = r"""(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Kinds in the order of their listing; `random` are the spans that the models add.
KINDS = ("assign", "access", "hex", "random")
ASSIGNED = 12

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
#: Words that are counted for the ordinary model.
WORD = r"[A-Za-z][a-z]{3,}"
#: Least log-likelihood ratio, in nats: in all, and per character pair.
LEAST, LEAST_EACH = 10.0, 0.35
#: Characters of a part of a long text, before the next character that ends it: one that no pattern takes.
PART = 1 << 14
_PARTS = r"""(?s).{%d}[\x20A-Za-z0-9+/_.=:"'-]*+[^\x20A-Za-z0-9+/_.=:"'-]|.+""" % PART
GENERATED = 2000
WORDS = ("get set user name value index count file path list map node state error config server client "
         "request response handler manager service session buffer thread query result table column row "
         "message event time date start end size length format parse build load save update delete "
         "create number string object array default option parameter return function method class "
         "nombre valor usuario fecha archivo cuenta lista nivel datos sistema fichier chemin valeur "
         "utilisateur compte niveau donnees systeme datei pfad wert benutzer konto liste stufe daten").split()  # fmt: skip


SPAN = "struct<start:int,end:int,token:string>"


def _matches(text, pattern: str, keep=None):
    """Array of (start, end, token) of a pattern's matches; keep: of group 2 of a match, whether it stays."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else whole
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), inner.alias("inner")), lambda x: x["whole"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(done, x):
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        found = F.concat(done["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("token"))))
        return F.struct(end.alias("at"), (F.when(keep(x["inner"]), found).otherwise(done["found"]) if keep else found).alias("found"))

    return F.when(F.size(whole) > 0, F.aggregate(rows, empty, step, lambda x: x["found"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def _blanked(text, spans):
    """The text with every span's characters replaced by spaces, in place."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(done, x):
        start, end = F.greatest(done["at"], x["start"]), F.greatest(done["at"], x["end"])
        return F.struct(end.alias("at"), F.concat(done["made"], F.substr(text, done["at"] + 1, start - done["at"]), F.repeat(F.lit(" "), end - start)).alias("made"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, begin, step, lambda x: F.concat(x["made"], F.substr(text, x["at"] + 1))))


def samples(spark: SparkSession, docs: DataFrame | None = None) -> DataFrame:
    """Labelled samples: (text, kind, n), kind one of random, identifier and word."""
    ids = spark.range(GENERATED)
    seed = F.concat(F.lit("sample-"), F.col("id").cast("string"))
    draw = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    length = 20 + draw("length", 24)
    base64 = F.translate(F.substring(F.base64(F.unhex(F.sha2(seed, 256))), F.lit(1), length), "=", "")
    forms = [base64, F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", "x"), F.lit(1), length), F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "7")), F.translate(base64, "+/", "-_")]
    random = ids.select(F.explode(F.array(*forms)).alias("text"))
    words = F.lit(list(WORDS))
    a, b, c = (F.element_at(words, draw(s, len(WORDS)) + 1) for s in ("a", "b", "c"))
    ordinary = [F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, c), F.upper(F.concat_ws("_", a, b)), F.concat(a, F.lit("_"), b, draw("n", 100).cast("string")), F.concat_ws("/", a, b, c), F.concat_ws("-", (1990 + draw("y", 60)).cast("string"), F.lpad((1 + draw("m", 12)).cast("string"), 2, "0"), F.lpad((1 + draw("d", 28)).cast("string"), 2, "0"))]
    found = random.select("text", F.lit("random").alias("kind")).union(ids.select(F.explode(F.array(*ordinary)), F.lit("identifier")))
    found = found.withColumn("n", F.lit(1).cast("long"))
    if docs is not None:
        # Words of all documents, counted before and after the shuffle.
        words = docs.select(F.explode(F.regexp_extract_all(text_column(), F.lit(WORD), F.lit(0))).alias("text"))
        found = found.union(words.groupBy("text").agg(F.count("*").alias("n")).select("text", F.lit("word"), "n"))
    return found


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of character pairs, row by row of ALPHABET, from samples (text, kind, n).

    The ordinary model is half identifiers, half words, whatever their numbers, so it doesn't depend on how
    many documents there are; a character that no word has follows identifiers alone.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = labelled.where(F.length("text") > 1).select("kind", "text", "n", at.alias("at")).select("kind", "n", F.expr("substr(text, at, 2)").alias("pair"))
    # At most 3 * len(ALPHABET)**2 rows.
    counted = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_-]{2}\z")).groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    n = len(ALPHABET)
    counts = {k: [[0.5] * n for _ in range(n)] for k in ("random", "identifier", "word")}
    for x in counted:
        counts[x.kind][ALPHABET.index(x.pair[0])][ALPHABET.index(x.pair[1])] += x.n
    share = {k: [[v / sum(row) for v in row] for row in rows] for k, rows in counts.items()}
    half = [0.5 if sum(row) > 0.5 * n else 0.0 for row in counts["word"]]
    ordinary = [[half[i] * share["word"][i][j] + (1 - half[i]) * share["identifier"][i][j] for j in range(n)] for i in range(n)]
    return [math.log(share["random"][i][j] / ordinary[i][j]) for i in range(n) for j in range(n)]


def ratio(token, table: list[float]):
    """Log-likelihood ratio of a token of ALPHABET's characters."""
    n, values, letters = len(ALPHABET), F.lit(table), F.lit(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(letters, c) - 1)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(values, a * n + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _tagged(spans, kind: str, at):
    """Spans of a part that starts at `at`, as (start, kind, end)."""
    return F.transform(spans, lambda x: F.struct((x["start"] + at).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["end"] + at).alias("end")))


def _joined(spans):
    names = F.lit(list(KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, table: list[float], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base spans, their digest, and all spans."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column(text).alias("text"))
    parts = F.when(F.length("text") <= PART, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(_PARTS), F.lit(0)))
    docs = docs.select("doc_id", parts.alias("part"))
    rules = {"assign": (ASSIGN, lambda inner: F.length(inner) >= ASSIGNED), "access": (ACCESS, None), "hex": (HEX, None)}
    of = lambda rule: F.transform("part", lambda x: _matches(x, *rule))
    found = docs.select("doc_id", "part", *(of(rule).alias(k) for k, rule in rules.items()))
    # Where the parts start.
    starts = F.aggregate("part", F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.length(x))))
    rest = F.transform(F.arrays_zip("part", *rules), lambda x: _matches(_blanked(x["part"], F.concat(*(x[k] for k in rules))), CANDIDATE))
    found = found.select("doc_id", *rules, rest.alias("rest"), starts.alias("starts"))
    is_random = lambda x: (ratio(x["token"], table) >= F.greatest(F.lit(LEAST), LEAST_EACH * (x["end"] - x["start"] - 1)))
    found = found.withColumn("random", F.transform("rest", lambda xs: F.filter(xs, is_random)))
    spans = lambda k: F.flatten(F.zip_with(k, F.slice("starts", F.lit(1), F.size(k)), lambda xs, at: _tagged(xs, k, at)))
    found = found.select("doc_id", *(F.aggregate(k, F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias(f"n_{k}") for k in rules), F.concat(*(spans(k) for k in rules)).alias("base"), spans("random").alias("random"))
    return found.select("doc_id", *(f"n_{k}" for k in rules), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "random")).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return scan(docs, train(samples(spark, docs)))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE: dict[str, str] = {}
