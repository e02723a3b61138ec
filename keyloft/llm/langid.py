"""Language identification by fusing evidence in Bayes' way.

Four kinds of evidence speak for a row's language: its text (naive Bayes over
hashed byte trigrams), the language that its markup declares, the suffix of its
address, and its host.  How far a declared language or a suffix is to be believed
is counted: by grouped aggregation over the languages that the texts alone
suggest.  A host's prior is smoothed towards its site's, that one towards the
prior of all rows, so a host with few pages leans on its site.  A row's own vote is
taken out of every count that is used on it.

``und`` stands for a text that no language explains better than chance.

The model is a table of languages times ``BUCKETS`` counts, summed over all
labelled rows; its size does not depend on the corpus.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, raw_texts, release_memory

#: Size of the trigram table, for each language.
BUCKETS = 1 << 16
UND = "und"
#: Trigrams overlap: each letter is in three.
TEMPER = 3.0
#: Share of rows that are taken to be in no known language beforehand.
UND_PRIOR = 1e-3
#: Rows that the prior of the level above weighs.
STRENGTH = 10.0
#: Trigrams looked up at once.
SLICE = 1 << 20

#: Letters stay, capitals become small, all other ASCII becomes a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def buckets_of(raw: bytes | None) -> np.ndarray:
    """Hashed trigrams of a text whose middle byte belongs to a word."""
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + raw.translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    middle = b[1:-1] != 32
    key = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[middle]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(docs: DataFrame, languages: list[str], *, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Log probabilities of the trigrams of each language, from all labelled rows."""
    narrow = docs.select(docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l"))

    def count(batches):
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        at = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            for raw, lang in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if lang in at:
                    sums[at[lang]] += np.bincount(buckets_of(raw), minlength=BUCKETS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], ["l", "b", "n"])

    labelled = narrow.filter(F.col("l").isin(languages))
    rows = labelled.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(languages), BUCKETS), 0.5)
    for row in rows:
        table[row["l"], row["b"]] += row["n"]
    return np.log(table / table.sum(1, keepdims=True))


def _text_evidence(model, languages: list[str]):
    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        table, out = model.value, []
        for raw in raw_texts(texts):
            found = buckets_of(raw)
            sums = np.zeros(len(languages))
            for lo in range(0, len(found), SLICE):
                sums += table[:, found[lo : lo + SLICE]].sum(1)
            # The last two: the chance level, and the number of trigrams.
            out.append([*(sums / TEMPER), -math.log(BUCKETS) * len(found) / TEMPER, float(len(found))])
        release_memory()
        return pa.array(out, pa.list_(pa.float64()))

    return evidence


def host_of(url: Column) -> Column:
    """The host of an address, in small letters; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def declared_of(html: Column) -> Column:
    """The main part of the language that a page's root element declares."""
    said = F.regexp_extract(html, r"(?i)<html\b[^<>]*?(?<![\w-])lang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.nullif(F.lower(said), F.lit(""))


_HIDDEN = re.compile(rb"<(script|style)\b", re.I)
_ENTITY = re.compile(rb"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);")


def page_text(raw: bytes) -> bytes:
    """A page without scripts, styles, comments, tags and entities, in one pass.

    What is opened and never closed is text, save that a script, style or comment
    without an end loses its tag.
    """
    low, out, at = raw.lower(), [], 0
    ends: dict[bytes, int] = {}

    def closing(mark: bytes, start: int) -> int:
        """Where the next ``mark`` begins; looked for once for all that come before it."""
        if mark not in ends or 0 <= ends[mark] < start:
            ends[mark] = low.find(mark, start)
        return ends[mark]

    while (lt := raw.find(b"<", at)) >= 0:
        out.append(raw[at:lt])
        hidden = _HIDDEN.match(raw, lt)
        end = -1
        if raw.startswith(b"<!--", lt):
            end = closing(b"-->", lt + 4)
        elif hidden:
            end = closing(b"</" + hidden.group(1).lower(), hidden.end())
        gt = closing(b"-->" if raw.startswith(b"<!--", lt) and end >= 0 else b">", max(end, lt)) if end >= 0 else closing(b">", lt)
        if gt < 0:
            at = lt
            break
        at = gt + (3 if end >= 0 and not hidden else 1)
    out.append(raw[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def text_of(html: Column) -> Column:
    """A page's text, see :func:`page_text`; null for null."""

    @F.arrow_udf("string")
    def bare(pages: pa.Array) -> pa.Array:
        made = [None if raw is None else page_text(raw) for raw in raw_texts(pages)]
        return pa.array(made, pa.binary()).cast(pa.string())

    return bare(html)


def identify(
    rows: DataFrame,
    model: np.ndarray,
    languages: list[str],
    *,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    keep: list[str],
    least: float = 0.5,
) -> DataFrame:
    """The language of each row.

    Returns the columns ``keep``, ``found_lang`` (``und`` for none), ``probability``,
    ``text_lang`` (what the text alone suggests), ``declared``, ``host``,
    ``suffix`` and ``accepted``: a known language of at least that probability,
    with a text that has letters.

    Null and empty texts leave the decision to the other evidence and are not
    accepted.  A null declared language or host says nothing.  Repeated rows are
    judged each for itself, though they vote for one host.  An empty table gives an
    empty result.  Very long texts are read whole, in slices.  A column of ``keep`` that
    is called as one of the result hides it; other columns are ignored.
    """
    names = [*languages, UND]
    n = len(names)
    sc = rows.sparkSession.sparkContext
    evidence = _text_evidence(sc.broadcast(model), languages)
    none = F.lit(None).cast("string")
    base = rows.select(
        *[rows[c].alias(f"_keep{i}") for i, c in enumerate(keep)],
        (none if declared is None else declared.cast("string")).alias("declared"),
        (none if host is None else host.cast("string")).alias("host"),
        F.coalesce(text.cast("string"), F.lit("")).alias("_t"),
    )
    base = base.withColumn("_e", evidence("_t")).drop("_t")
    base = base.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))
    base = base.withColumn("site", F.substring_index("host", ".", -2))
    chance = [math.log((1 - UND_PRIOR) / len(languages))] * len(languages) + [math.log(UND_PRIOR)]
    alone = F.array(*[F.col("_e")[i] + F.lit(chance[i]) for i in range(n)])
    base = cut(base.withColumn("_top", F.array_position(alone, F.array_max(alone)).cast("int") - 1))

    def votes(column: str | None, name: str) -> DataFrame:
        seen = base if column is None else base.filter(F.col(column).isNotNull())
        sums = F.array(*[F.count_if(F.col("_top") == i) for i in range(n)]).alias(name)
        return seen.agg(sums) if column is None else seen.groupBy(F.col(column).alias(f"_k_{column}")).agg(sums)

    total = votes(None, "n").first()["n"]  # one number for each language
    joined = base
    for column in ("declared", "suffix", "site", "host"):
        table = votes(column, f"_n_{column}")
        joined = joined.join(table, joined[column] == table[f"_k_{column}"], "left").drop(f"_k_{column}")

    own = [(F.col("_top") == i).cast("double") for i in range(n)]
    every = sum(total)
    overall = [(F.lit(total[i] + 1.0) - own[i]) / F.lit(every + n - 1.0) for i in range(n)]

    def count(column: str, i: int) -> Column:
        return F.coalesce(F.col(f"_n_{column}")[i] - own[i], F.lit(0.0))

    def smoothed(column: str, above: list[Column]) -> list[Column]:
        size = F.coalesce(F.aggregate(f"_n_{column}", F.lit(0).cast("long"), lambda a, x: a + x) - 1, F.lit(0))
        return [(count(column, i) + STRENGTH * above[i]) / (size + STRENGTH) for i in range(n)]

    def likelihood(column: str, i: int) -> Column:
        """Of what was seen, given the language, over its chance in any."""
        size = F.coalesce(F.aggregate(f"_n_{column}", F.lit(0).cast("long"), lambda a, x: a + x) - 1, F.lit(0))
        share = (size + 1.0) / (every + 1.0)
        return (count(column, i) + STRENGTH * share) / (F.lit(total[i] + STRENGTH) - own[i]) / share

    prior = smoothed("host", smoothed("site", overall))
    # Rows fuse their own numbers only, so this stays one projection.
    logs = []
    for i in range(n):
        told = F.col("_e")[i] + F.log(prior[i])
        for column in ("declared", "suffix"):
            told += F.when(F.col(column).isNotNull(), F.log(likelihood(column, i))).otherwise(0.0)
        logs.append(told)
    fused = joined.withColumn("_l", F.array(*logs)).withColumn("_m", F.array_max("_l"))
    weight = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m")))
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("_l", F.col("_m")).cast("int"))
    fused = fused.withColumn("probability", 1 / weight).withColumn("lang_found", name)
    first = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_top") + 1)
    accepted = (F.col("lang_found") != UND) & (F.col("probability") >= least) & (F.element_at("_e", -1) > 0)
    found = {"found_lang": F.col("lang_found"), "probability": F.col("probability"), "text_lang": first, "accepted": accepted}
    found |= {c: F.col(c) for c in ("declared", "host", "suffix")}
    order = ["found_lang", "probability", "text_lang", "declared", "host", "suffix", "accepted"]
    kept = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    return fused.select(*kept, *[found[c].alias(c) for c in order if c not in keep])
