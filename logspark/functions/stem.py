"""Word search by Porter stems (M. F. Porter, An algorithm for suffix stripping, 1980), over folded unicode words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Versions

# Suffixes of the steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a folded word; words that aren't ASCII letters are their own stems."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    return word[:-1] if _measure(word) > 1 and _double(word) and word[-1] == "l" else word


def stems(text: str | None) -> list[str]:
    """Distinct stems of a text's words, without diacritics."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return sorted({stem(w) for w in re.findall(r"[^\W_]+", folded)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(text: pd.Series) -> pd.Series:
    return pd.Series([stems(t) for t in text], dtype=object)


def stem_search(query: str) -> Column:
    """Every word of the query occurs in the message or exception, by stem."""
    wanted = stems(query)
    have = stem_tokens(F.concat_ws("\n", "message", "exception"))
    return F.lit(True) if not wanted else F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in wanted]))) == len(wanted)


def token_table(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stem): a row for each distinct stem of an event's words."""
    return events.select(*keys, F.explode(stem_tokens(F.concat_ws("\n", "message", "exception"))).alias("stem"))


class StemIndex:
    """An inverted index over stored events, for repeated word searches; kept beside the store as committed versions (shared.Versions).

    Postings are (stem, id) by app and day, sorted by stem, so a search reads the days it asks for and, by the statistics in the files, the stems it asks for.
    Frequencies are the events of each stem by app and day: a search reads them first and goes through the postings from the rarest stem on. Texts are read when events
    are added, never by a search.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def add(self, events: DataFrame, salt: int = 8) -> None:
        """Indexes events that aren't there yet, for example those of a stream's batch."""
        last = self.versions.committed()
        number = 0 if last is None else last + 1
        tokens = token_table(events, ["app_id", "day", "id"])
        dealt = tokens.repartition("app_id", "day", F.pmod(F.xxhash64("stem"), F.lit(salt))).sortWithinPartitions("app_id", "day", "stem", "id")
        self.versions.write("postings", number, dealt, partition_by=("app_id", "day"))
        postings = self.spark.read.schema(POSTING).parquet(self.versions.folder("postings", number))
        self.versions.write("frequencies", number, postings.groupBy("app_id", "day", "stem").agg(F.count("*").alias("n")))
        self.versions.commit(number)

    def _read(self, table: str, schema: str, apps: list[str] | None, start, end) -> DataFrame:
        last = self.versions.committed()
        df = self.spark.createDataFrame([], schema + ", version bigint") if last is None else self.spark.read.schema(schema + ", version bigint").parquet(f"{self.versions.path}/{table}").where(F.col("version") <= last)
        if apps is not None:
            df = df.where(F.col("app_id").isin(apps))
        if start is not None:
            df = df.where(F.col("day") >= F.lit(start).cast("date"))
        return df if end is None else df.where(F.col("day") <= F.lit(end).cast("date"))

    def search(self, query: str, apps: list[str] | None = None, start=None, end=None) -> DataFrame:
        """(app_id, day, id) of the events that hold every word of the query, by stem."""
        wanted = stems(query)
        postings = self._read("postings", POSTING, apps, start, end)
        if not wanted:
            return postings.select("app_id", "day", "id").distinct()
        count = self._read("frequencies", "app_id string, day date, stem string, n bigint", apps, start, end).where(F.col("stem").isin(wanted)).groupBy("stem").agg(F.sum("n").alias("n"))
        often = {r["stem"]: r["n"] for r in count.collect()}  # a row for each word of the query
        rare = sorted(wanted, key=lambda w: (often.get(w, 0), w))
        found = postings.where(F.col("stem") == rare[0]).select("app_id", "day", "id")
        if often.get(rare[0], 0) == 0:
            return found.where(F.lit(False))
        for w in rare[1:]:
            found = found.join(postings.where(F.col("stem") == w).select("app_id", "day", "id"), ["app_id", "day", "id"], "left_semi")
        return found


POSTING = "app_id string, day date, stem string, id bigint"
