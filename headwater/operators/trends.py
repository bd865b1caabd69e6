"""Terms in titles, their scores, greedy suppression of redundant ones, and heat of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.sources.tables import cut

#: Our own watch terms (name, pattern), tuned to the test tables.
WATCH = [("the", r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"), ("licence", "(?i)licen[sc]e"), ("is", r"(?<![A-Za-z0-9_])is(?![A-Za-z0-9_])"), ("der", r"(?<![A-Za-z0-9_])der(?![A-Za-z0-9_])"), ("que", r"(?<![A-Za-z0-9_])que(?![A-Za-z0-9_])"), ("was", r"(?<![A-Za-z0-9_])was(?![A-Za-z0-9_])"), ("for", r"(?<![A-Za-z0-9_])for(?![A-Za-z0-9_])"), ("with", r"(?<![A-Za-z0-9_])with(?![A-Za-z0-9_])")]
COLUMNS = ["en", "fr", "de", "es"]
#: Fixed value, as the same names must be found: a letter, then letters, digits and the signs that names hold.
NAME_SHAPE = r"^\p{L}[\p{L}\p{N}.+&'’-]*$"
#: Our own words that never name anything.
STOP = ["the", "is", "it", "der", "la"]


def watch_hits(items: DataFrame, watch: list[tuple[str, str]] = WATCH) -> DataFrame:
    """A row for each item and watch term found in its title; the few terms are unfolded in the row."""
    terms = F.filter(F.array(*[F.when(F.col("title").rlike(p), F.lit(n)) for n, p in watch]), lambda t: t.isNotNull())
    return items.select("*", F.explode(terms).alias("term"))


def proper_nouns(items: DataFrame, id_col: str = "doc_id", stop: list[str] | None = None) -> DataFrame:
    """(id, term): runs of capitalised words of titles, their first three words.

    A run ends at an unusable word or after a word with a closing sign. The first word of a title is usable
    only if its capitals are inside the word.
    """
    stop = stop or STOP
    word = F.col("t.w")
    placed = items.select(F.col(id_col).alias("id"), F.posexplode(X.tokens(F.col("title"))).alias("i", "t"))
    shaped = word.rlike(r"^\p{L}.*[\p{L}\p{N}+]$") & word.rlike(r"\p{L}.*\p{L}")
    named = X.is_distinctive(word) | (word.rlike(r"^\p{Lu}") & (F.col("i") > 0))
    usable = shaped & named & ~F.lower(word).isin(*stop)
    by = Window.partitionBy("id").orderBy("i")
    marked = placed.select("id", "i", word.alias("w"), usable.alias("usable"), F.col("t.stop").alias("stop"))
    cut = (~F.col("usable")).cast("int") + F.coalesce(F.lag("stop").over(by).cast("int"), F.lit(0))
    runs = marked.withColumn("cut", cut).withColumn("run", F.sum("cut").over(by)).where("usable")
    term = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]), 1, 3), " ")
    return runs.groupBy("id", "run").agg(term.alias("term")).select("id", "term").distinct()


def title_case_sources(items: DataFrame, least_words: int = 12, ratio: float = 0.6, stop: list[str] = STOP) -> DataFrame:
    """(source, words, caps, title_case): how many longer words after the first are capitalised."""
    placed = items.select("source", F.posexplode(X.tokens(F.col("title"))).alias("i", "t")).where("i > 0")
    word = F.col("t.w")
    fit = placed.where((F.length(word) > 3) & word.rlike(r"^\p{L}") & ~F.lower(word).isin(*stop))
    counts = fit.groupBy("source").agg(F.count(F.lit(1)).alias("words"), F.count_if(word.rlike(r"^\p{Lu}")).alias("caps"))
    return counts.withColumn("title_case", (F.col("words") >= least_words) & (F.col("caps") / F.col("words") > ratio))


def recency(date: Column, now: Column) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(date)
    return F.when(age < 12 * 3600, 1.6).when(age < 24 * 3600, 1.3).otherwise(1.0).cast("decimal(4,1)")


def trend_scores(hits: DataFrame, now: Column, least_count: int = 2, least_sources: int = 2, columns: list[str] = COLUMNS) -> DataFrame:
    """(term, count, sources, column, score, ids): decimals, so that the order of summing never shows."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int"), F.lit(0))
    ord_ = F.when(place == 0, 99).otherwise(place)
    per = hits.groupBy("term", "column").agg(F.count_distinct("id").alias("n"))
    top = per.groupBy("term").agg(F.max_by("column", F.struct("n", (-ord_).alias("o"), "column")).alias("column"))
    unique = hits.dropDuplicates(["term", "id"])
    stats = unique.groupBy("term").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_distinct("source").alias("sources"),
        F.sum(recency(F.col("date"), now)).alias("weight"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_millis("date")).alias("d"), "id"))), lambda s: s["id"]).alias("ids"),
    )
    stats = stats.where((F.col("count") >= least_count) & (F.col("sources") >= least_sources)).join(top, "term")
    score = (F.col("sources") * F.lit(1.2).cast("decimal(4,1)") + F.col("weight")).cast("decimal(18,1)")
    return stats.select("term", "count", "sources", "column", score.cast("double").alias("score"), "ids")


def lookback(items: DataFrame, now: Column, least: int = 60, hours: tuple[int, ...] = (48, 96)) -> DataFrame:
    """The rows of the last 48 hours, else 96, else all, whichever first has ``least`` rows; one aggregation decides."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("date")) / 3600
    counts = items.agg(*[F.count_if(age <= h).alias(f"h{h}") for h in hours])
    width = F.coalesce(*[F.when(F.col(f"h{h}") >= least, float(h)) for h in hours], F.lit(float("inf")))
    return items.crossJoin(F.broadcast(counts.select(width.alias("_hours")))).where(age <= F.col("_hours")).drop("_hours")  # one row


def mined_terms(items: DataFrame, title_case: DataFrame, stop: list[str] = STOP) -> DataFrame:
    """A row for each item and name found in its title: the columns of ``items``, k (its place) and term.

    Titles are short, so the runs of a title are found within its row. A run is cut at words that cannot name
    anything and after closing signs; its first three words are a term. Each word of a longer run is one too if it
    has an inner capital or is known, that is, stands with a capital inside a title of a source that does not
    write all words so. Such sources, (source, title_case), give only runs of words with inner capitals. The
    first word of a title counts only if it has an inner capital or is known.
    """
    named = items.join(title_case.where("title_case").select("source", F.lit(True).alias("_tc")), "source", "left")
    placed = named.withColumn("_tc", F.coalesce("_tc", F.lit(False))).withColumn("_t", X.tokens(F.coalesce("title", F.lit(""))))
    capital = lambda w: w.rlike(r"^\p{Lu}") | X.is_distinctive(w)
    plain = lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*stop)
    inside = placed.where(~F.col("_tc")).select(F.explode(F.slice("_t", 2, 1_000_000)["w"]).alias("w"))
    known = inside.where(plain(F.col("w")) & capital(F.col("w"))).select("w").distinct()
    opened = placed.withColumn("_first", F.get("_t", F.lit(0))["w"]).join(known.select(F.col("w").alias("_first"), F.lit(True).alias("_known")), "_first", "left")

    def mark(t: Column, i: Column) -> Column:
        w = t["w"]
        shaped = w.rlike(NAME_SHAPE) & w.rlike(r"\p{L}.*\p{L}")
        usable = shaped & capital(w) & plain(w) & ((i > 0) | X.is_distinctive(w) | F.coalesce("_known", F.lit(False)))
        return F.when(~usable, "\n").otherwise(F.concat(w, F.when(t["stop"], "\n").otherwise("")))

    runs = F.split(F.array_join(F.transform("_t", mark), " "), " *\n[ \n]*")
    short = F.filter(F.transform(runs, lambda r: F.regexp_extract(F.trim(r), r"^\S+(?: \S+){0,2}", 0)), lambda r: r != "")
    odd = lambda w: X.is_distinctive(w)
    whole = F.transform(F.filter(short, lambda r: ~F.col("_tc") | F.forall(F.split(r, " "), odd)), lambda r: F.struct(r.alias("term"), F.lit(False).alias("ask")))
    words = F.flatten(F.transform(F.filter(short, lambda r: r.contains(" ")), lambda r: F.transform(F.split(r, " "), lambda w: F.struct(w.alias("term"), (~odd(w)).alias("ask")))))
    listed = opened.select(*items.columns, F.posexplode(F.concat(whole, words)).alias("k", "_x")).select(*items.columns, "k", F.col("_x.term").alias("term"), F.col("_x.ask").alias("_ask"))
    sure = listed.where(~F.col("_ask"))
    asked = listed.where("_ask").join(known.withColumnRenamed("w", "term"), "term", "left_semi")
    return sure.unionByName(asked).drop("_ask")


def all_hits(items: DataFrame, history: DataFrame, watch: list[tuple[str, str]] = WATCH, stop: list[str] = STOP, block: str | None = None) -> DataFrame:
    """(term, watched, id, column, source, date, place): each term of each item once, watched or mined.

    Mined terms that are stopped, blocked or hit by a watch term go. ``history`` tells which sources write
    all words with capitals. place orders terms by where they were first met.
    """
    base = items.select("id", "column", "source", "title", "date", "doc_id")
    watched = watch_hits(base, watch).withColumn("k", F.array_position(F.array(*[F.lit(n) for n, _ in watch]), F.col("term")).cast("int"))
    mined = mined_terms(base, title_case_sources(history, stop=stop), stop)
    bad = F.lower("term").isin(*stop)
    for pattern in [*([block] if block else []), *[p for _, p in watch]]:
        bad = bad | F.col("term").rlike(pattern)
    both = watched.withColumn("watched", F.lit(True)).unionByName(mined.where(~bad).withColumn("watched", F.lit(False)))
    place = F.struct("doc_id", (~F.col("watched")).alias("mined"), "k")
    return both.groupBy("term", "id").agg(*[F.min(c).alias(c) for c in ("column", "source", "date")], F.max("watched").alias("watched"), F.min(place).alias("place"))


def score_terms(hits: DataFrame, now: Column, least_watched: int = 2, least_mined: int = 3, least_sources: int = 2, columns: list[str] = COLUMNS) -> DataFrame:
    """(term, count, sources, column, score, place) of the terms with enough items and sources; hits are distinct
    on (term, id). Counts by term, source and column come first, so that a frequent term is no hot key."""
    some = hits.groupBy("term", "source", "column").agg(F.count(F.lit(1)).alias("n"), F.sum(recency(F.col("date"), now)).alias("weight"), F.max("watched").alias("watched"), F.min("place").alias("place"))
    at = F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int")
    order = F.when(F.coalesce(at, F.lit(0)) == 0, 99).otherwise(at)
    lead = some.groupBy("term", "column").agg(F.sum("n").alias("n")).groupBy("term").agg(F.max_by("column", F.struct("n", (-order).alias("o"), "column")).alias("column"))
    sums = some.groupBy("term").agg(F.sum("n").alias("count"), F.count_distinct("source").alias("sources"), F.sum("weight").alias("weight"), F.max("watched").alias("watched"), F.min("place").alias("place")).join(lead, "term")
    fit = (F.col("count") >= F.when(F.col("watched"), least_watched).otherwise(least_mined)) & (F.col("sources") >= least_sources)
    score = (F.col("sources") * F.lit(1.2).cast("decimal(4,1)") + F.col("weight")).cast("decimal(18,1)")
    return sums.where(fit).select("term", "count", "sources", "column", score.cast("double").alias("score"), "place")


def suppress_redundant(scored: DataFrame, hits: DataFrame, last: str = "term", limit: int = 12, overlap: float = 0.8, chunk: int = 100) -> DataFrame:
    """Walks the terms by score, sources and ``last``; drops one that mostly repeats a kept one; ``limit`` stay.

    scored: (term, count, sources, score, ...); hits: (term, id), distinct. The walk reads the ranking in chunks of
    ``chunk`` rows until enough are kept or none are left; how many items two terms share is counted by joins
    on the item, for the terms at hand alone. The driver holds one chunk and the kept terms.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.desc("sources"), F.asc(last)]
    ranking = cut(scored.select(*dict.fromkeys(["term", "count", "sources", "score", last])), "trends")
    kept, done = [], 0
    while len(kept) < limit:
        some = ranking.orderBy(*order).offset(done).limit(chunk).select("term", "count", "sources", "score").collect()
        if not some:
            break
        done += len(some)
        names = spark.createDataFrame([(r.term,) for r in [*kept, *some]], "term string")
        own = hits.join(F.broadcast(names), "term").select("id", "term")
        pairs = own.alias("x").join(own.alias("y"), "id").where("x.term < y.term").groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        shared = {(r.a, r.b): r.n for r in pairs.collect()}
        for r in some:
            repeats = any(shared.get((min(r.term, k.term), max(r.term, k.term)), 0) / min(r["count"], k["count"]) >= overlap for k in kept)
            if not repeats and len(kept) < limit:
                kept.append(r)
    return spark.createDataFrame([(i, r.term, r.score) for i, r in enumerate(kept, 1)], "rank long, term string, score double")


def item_heat(items: DataFrame, trends: DataFrame) -> DataFrame:
    """(id, heat): the scores of the trends that hold an item; 0 where there are none."""
    heat = trends.select(F.explode("ids").alias("id"), F.col("score").cast("decimal(18,1)").alias("s")).groupBy("id").agg(F.sum("s").alias("s"))
    return items.select("id").join(heat, "id", "left").select("id", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("heat"))


def trend_rows(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """The selected trends (rank, term, score), a dozen, with count, sources and column."""
    return scored.join(F.broadcast(selected.select("rank", "term")), "term").select("rank", "term", "score", "count", "sources", "column")


def trend_items(selected: DataFrame, hits: DataFrame) -> DataFrame:
    """(rank, term, id): a row for each item of each selected trend; ``hits`` are distinct on (term, id)."""
    return hits.join(F.broadcast(selected.select("rank", "term")), "term").select("rank", "term", "id")


def selected_heat(items: DataFrame, selected: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, heat): the scores of the selected trends that hold an item, watched and mined; 0 where there are none."""
    score = F.broadcast(selected.select("term", F.col("score").cast("decimal(18,1)").alias("s")))
    heat = hits.join(score, "term").groupBy("id").agg(F.sum("s").alias("s"))
    return items.select("id").join(heat, "id", "left").select("id", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("heat"))
