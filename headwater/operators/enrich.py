"""Caches and batched inference."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.sources.tables import swap_in


def look_up(items: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Adds the cached value and ``state``: hit, known_missing (an empty value) or miss."""
    met = items.join(cache.select(key, value), key, "left")
    return met.withColumn("state", F.when(F.col(value).isNull(), "miss").when(F.col(value) == "", "known_missing").otherwise("hit"))


def collect_garbage(cache: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Only entries that this run used stay."""
    return cache.join(items.select(key).distinct(), key, "left_semi")


def write_sorted_cache(cache: DataFrame, path: str, key: str) -> None:
    """Writes a cache as JSON lines in the order of its key over all files, so that a run that changes few entries changes
    few lines; the newest of equal keys is the caller's to choose. The old cache stays until the new one is whole."""
    aside = f"{path}.new-{uuid.uuid4().hex}"
    cache.repartitionByRange(key).sortWithinPartitions(key).write.json(aside)
    swap_in(cache.sparkSession, aside, path)


def batched_inference(items: DataFrame, model: Callable[[list[str]], list[str | None]], id_col: str, text_col: str, batch: int = 20, retry_batch: int = 10) -> DataFrame:
    """(id, output, tries): each row is asked once in batches, leftovers once more in smaller ones.

    A failing batch leaves its rows without output; rows that stay without are dropped by the caller.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(texts: list[str]) -> list[str | None]:
            try:
                return model(texts)
            except Exception:  # noqa: BLE001  a failed batch is retried, then given up
                return [None] * len(texts)

        for frame in frames:
            texts, out, tries = frame[text_col].fillna("").tolist(), [], [1] * len(frame)
            for i in range(0, len(texts), batch):
                out += ask(texts[i : i + batch])
            again = [i for i, x in enumerate(out) if x is None]
            for i in range(0, len(again), retry_batch):
                some = again[i : i + retry_batch]
                for k, x in zip(some, ask([texts[k] for k in some]), strict=True):
                    out[k], tries[k] = x, 2
            yield pd.DataFrame({"id": frame[id_col], "output": out, "tries": tries})

    return items.select(id_col, text_col).mapInPandas(run, f"id {items.schema[id_col].dataType.simpleString()}, output string, tries long")


def gated_look_up(items: DataFrame, cache: DataFrame, key: str, original: str, value: str, foreign: list[str], own: list[str]) -> DataFrame:
    """A cached output counts as a hit only if it is translated; else the row is a miss and asked again."""
    met = items.join(cache.select(key, value), key, "left")
    good = F.col(value).isNotNull() & ~X.untranslated(F.col(original), F.col(value), foreign, own)
    return met.withColumn(value, F.when(good, F.col(value))).withColumn("state", F.when(good, "hit").otherwise("miss"))


def merge_outputs(items: DataFrame, outputs: DataFrame, key: str, language: str = "en") -> DataFrame:
    """Rows of ``language`` take title and summary of their output and go without one; other rows pass through. A
    row that had no summary gets none. outputs: (key, new_title, new_summary), one row for a key."""
    met = items.join(outputs, key, "left").where((F.coalesce("lang", F.lit("")) != language) | F.col("new_title").isNotNull())
    asked = F.col("lang") == language
    summary = F.when(asked & (F.coalesce("summary", F.lit("")) != ""), F.coalesce("new_summary", F.lit(""))).when(asked, "").otherwise(F.col("summary"))
    return met.withColumns({"title": F.when(asked, F.col("new_title")).otherwise(F.col("title")), "summary": summary}).drop("new_title", "new_summary")


def restore_case(original: Column, output: Column, keep_lower: frozenset[str] = frozenset()) -> Column:
    """The output with the spelling of its original: words with inner capitals and acronyms, then names that came
    back in lower case (but those in ``keep_lower``), then the capital at the start. Nulls count as empty."""
    import regex

    odd, name = regex.compile(r"\p{Ll}\p{Lu}|^\p{Lu}{2,}\p{N}*$"), regex.compile(r"^\p{P}*(\p{Lu}\p{Ll}{2,})(?!\p{L})")
    piece = regex.compile(r"[\p{L}\p{N}]+")

    def mend(source: str, text: str) -> str:
        special = {w.lower(): w for w in piece.findall(source) if odd.search(w)}
        names = {m[1].lower(): m[1] for m in map(name.match, source.split()[1:]) if m and m[1].lower() not in keep_lower}

        def spell(m) -> str:
            w = m[0]
            return special.get(w.lower()) or (names.get(w, w))

        out = piece.sub(spell, text)
        first = out.split()[0] if out.split() else ""
        if source.strip()[:1].isupper() and out[:1].islower() and first not in special.values():
            out = out[0].upper() + out[1:]
        return out

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mend(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=object)

    return run(original, output)
