"""Language identification by words first, then shorter and shorter character n-grams.

A model is learnt from labelled rows: log frequencies per language of words, and of the character n-grams of words
with their ends marked. A text's words are scored by their log frequencies where the model has them; a word it
doesn't have is scored by the longest n-grams of it that it does have, at each position of the word. The language
with the highest sum wins, the first by name among equals; the score is its share of the probability.

The one bound, a parameter: about `rows` labelled rows per language (those of the smallest hashes of the id), whole
texts. All words and n-grams of these are in the model, unless `words` or `grams` are given: then that many per language and
length, the most frequent, equal counts by value. Every text is then scored from all of its words.

Cases: null, empty and letterless texts give `und` with score 0; upper case is folded; repeated rows score alike;
rows without a language or id take no part in learning; without any labelled rows all is `und`. A word is a run of
letters (Unicode L) in learning and in scoring alike; numbers of any script are none. Other columns are ignored (or
kept, in `identify`; its own columns take the place of input columns of the same name).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, packed, stored, unpacked

WORD = regex.compile(r"\p{L}+")
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Characters of texts that are scored together.
AT_ONCE = 1 << 20


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


class Model:
    """Log frequencies over langs: of words, and of n-grams less what an n-gram that was never seen has."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[list[str], np.ndarray]]):
        """tables: per order (0: words) the values and a row of scores for each."""
        self.langs = langs
        none = [], np.empty((0, len(langs)))
        values, self.word_rows = tables.get(0, none)
        self.words = {w: i for i, w in enumerate(values)}
        self.grams: dict[int, dict[str, int]] = {}
        parts, at = [], 0
        for order in ORDERS:
            values, rows = tables.get(order, none)
            self.grams[order] = {g: at + i for i, g in enumerate(values)}
            parts.append(rows)
            at += len(values)
        self.gram_rows = np.concatenate(parts)

    def backed_off(self, word: str) -> list[int]:
        """At each position of a word, the longest n-gram that is known."""
        marked, found = f"<{word}>", []
        four, three, two, one = (self.grams[o] for o in ORDERS)
        for i in range(len(marked)):
            if (r := four.get(marked[i : i + 4])) is None and (r := three.get(marked[i : i + 3])) is None and (r := two.get(marked[i : i + 2])) is None:
                r = one.get(marked[i])
            if r is not None:
                found.append(r)
        return found

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of scores per word."""
        out = np.zeros((len(words), len(self.langs)))
        at = [self.words.get(w, -1) for w in words]
        known = np.array(at, dtype=np.intp)
        out[known >= 0] = self.word_rows[known[known >= 0]]
        new, parts, sizes = [], [], []
        for i, r in enumerate(at):
            if r < 0 and (found := self.backed_off(words[i])):
                new.append(i)
                parts += found
                sizes.append(len(found))
        if new:
            # a word counts as one observation, however many n-grams tell of it
            n = np.array(sizes)
            out[new] = np.add.reduceat(self.gram_rows[parts], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(lang, score) of each text; words that several texts share are scored once."""
        index: dict[str, int] = {}
        owners: list[int] = []
        ids: list[int] = []
        times: list[int] = []
        for i, t in enumerate(texts):
            counts = Counter(words_in(t))
            owners += [i] * len(counts)
            times += counts.values()
            ids += [index.setdefault(w, len(index)) for w in counts]
        if not ids or not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        scores = self.of_words(list(index))
        starts = np.flatnonzero(np.r_[True, np.diff(owners) > 0])
        totals = np.add.reduceat(scores[ids] * np.array(times)[:, None], starts, axis=0)
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1)[:, None]).sum(axis=1)
        out = [(UNKNOWN, 0.0)] * len(texts)
        for s, b, p in zip(starts, best, share):
            out[owners[s]] = (self.langs[b], float(p))
        return out


def _most(counts: DataFrame, kind: Column, most: int | None) -> DataFrame:
    """counts (lang, order, value, n), of those of a kind the `most` most frequent per language and order."""
    if most is None:
        return counts
    place = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_r", place).where(~kind | (F.col("_r") <= most)).drop("_r")


def counted(sample: DataFrame) -> DataFrame:
    """(lang, order, value, n) of sample (lang, _t): how often its words (order 0) and their n-grams occur."""
    word = F.explode(F.split(F.lower("_t"), r"[^\p{L}]+")).alias("value")
    words = stored(sample.select("lang", word).where("value <> ''").groupBy("lang", "value").agg(F.count("*").alias("n")), "words")
    # every order in one pass: a word's n-grams are counted as often as the word
    marked = F.concat(F.lit("<"), F.col("value"), F.lit(">"))

    def pieces(order: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - order + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(F.lit(order).alias("order"), F.substring(marked, i, F.lit(order)).alias("value")))

    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*map(pieces, ORDERS)))).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    return stored(words.select("lang", F.lit(0).alias("order"), "value", "n").unionByName(grams.select("lang", "g.order", "g.value", "n")), "counts")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 3000, words: int | None = None, grams: int | None = None) -> Model:
    """A model of labelled rows."""
    known = labelled.select(col(id_col).alias("_id"), col(text_col).alias("_t"), col(lang_col).alias("lang")).where("_id is not null and lang is not null and _t is not null")
    # rows of the smallest hashes, as a share that gives about `rows` of each language
    sizes = [(r.lang, 2**20 * min(1.0, rows / r.n)) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    share = labelled.sparkSession.createDataFrame(sizes, "lang string, _below double")
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("_id"), F.lit(2**20)) < F.col("_below"))
    chosen = _most(_most(counted(sample), F.col("order") == 0, words), F.col("order") > 0, grams)
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    # a row per value with its counts in all languages, which reaches the driver in columns, order by order
    of_lang = F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs]) if langs else F.array().cast("array<bigint>")
    wide = stored(chosen.groupBy("order", "value").agg(of_lang.alias("n")), "values")
    tables = {}
    for order in (0, *ORDERS):
        found = wide.where(F.col("order") == order).orderBy("value").select("value", "n").toArrow()
        seen = found["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs)).astype(float) if len(found) else np.empty((0, len(langs)))
        # half a count for what a language hasn't shown
        total = seen.sum(axis=0) + 0.5 * max(1, len(seen))
        tables[order] = found["value"].to_pylist(), np.log((seen + 0.5) / total) - np.log(0.5 / total)
    return Model(langs, tables)


def predict_column(model: Model, text: Column, spark) -> Column:
    """struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        rows, part, held = [], [], 0
        for i, t in enumerate(texts):
            part.append(t)
            held += len(t or "")
            if held >= AT_ONCE or i == len(texts) - 1:
                rows += shared.value.predict(part)
                part, held = [], 0
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predicted(text)


#: The columns that `identify` adds.
ADDED = ("lang_pred", "score")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    found = packed(docs, _p=predict_column(model, col(text_col), docs.sparkSession))
    return found.select(*unpacked(docs.columns, ADDED), *[F.col(f"_p.{n}") for n in ADDED])
