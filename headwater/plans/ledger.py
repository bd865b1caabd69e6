"""Plans of tables that change, of look-ups by index and of signed tokens; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.functions import tokens
from headwater.operators import run, search, state, trends
from headwater.plans.queries import anchor, event_stream, heads, mined_hits, news_log
from headwater.sources.tables import cut, table, work_dir
from headwater.sources.versioned import BucketTable
from headwater.streaming import keyed_state, micro_batches, supervise

#: Days of the month that end a delivery of the news log.
DELIVERIES = (8, 16, 24, 31)
#: Our own words, common in the languages of the test tables.
COMMON = "the of and in that is was for with on as by at from or an be it not are le la les des une dans que qui pour sur pas est der die das und ist von mit den ein eine nicht auf el los las una por con para como más su del se un en no".split()
TOKEN_KEY = b"a key for the test tables alone"
TOKEN_TIME = 1_705_276_800


def _replayed(spark, d) -> BucketTable:
    """The news log in four deliveries, each of which comes twice."""
    news = BucketTable(spark, f"{work_dir(spark)}/replay-{uuid.uuid4().hex}", "id", micro_batches.NEWS, 16, "first_seen")
    log, begin = news_log(spark, d), 0
    for number, end in enumerate(DELIVERIES):
        part = log.where((F.dayofmonth("ts") > begin) & (F.dayofmonth("ts") <= end))
        for _ in range(2):
            news.merge(part, state.merge_news, "replay", number)
        begin = end
    return news


def versioned_upsert(spark, d):
    return _replayed(spark, d).read().withColumn("first_seen", F.unix_timestamp("first_seen"))


def versioned_history(spark, d):
    """Rows and the largest heat of each version."""
    news, found = _replayed(spark, d), None
    for version in news.versions():
        rows = news.read(version).agg(F.count(F.lit(1)).alias("n"), F.max("heat").alias("heat")).select(F.lit(version).cast("long").alias("version"), "n", "heat")
        found = rows if found is None else found.unionByName(rows)
    return found


def stream_expiring_state(spark, d):
    """News by user and day, as keyed state that expires ten days after it was first seen."""
    e = event_stream(spark, d)
    image = F.when(F.col("value") > 50, F.concat(F.lit("img"), F.col("event_id").cast("string")))
    log = e.select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("title"), image.alias("image"), F.col("props").alias("url"), F.col("value").alias("heat"))
    return keyed_state.expiring_news(spark, log, days=10, by_clock=False).read().withColumn("first_seen", F.unix_timestamp("first_seen"))


def date_parse_zones(spark, d):
    """Instants written in ten forms, with zones, seconds and fractions."""
    at = lambda hours, form: F.date_format(F.col("ts") + F.expr(f"interval {hours} hours"), form)
    forms = [
        at(0, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), at(-5, "d MMM yyyy HH:mm:ss 'EST'"), at(-3, "dd MMM yyyy HH:mm:ss '-0300'"), at(2, "yyyy-MM-dd'T'HH:mm:ss.S'+02:00'"),
        at(0, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), at(0, "yyyy-MM-dd'T'HH:mm'Z'"), at(-7, "dd MMM yy HH:mm 'PDT'"), at(0, "MMMM d, yyyy"), at(0, "MMM d, yyyy h:mm a"), F.concat(at(0, "dd MMM yyyy HH:mm:ss"), F.lit(" somewhere")),
    ]
    form = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        form = F.when(F.col("event_id") % len(forms) == k, f).otherwise(form)
    return table(spark, d, "events").select("event_id", F.unix_millis(X.parse_date(form)).alias("epoch_ms"))


def token_checks_signed(spark, d):
    """Tokens of events, some forged, unsigned, out of time or for others."""
    n, t = F.col("event_id"), F.unix_timestamp("ts")
    claims = F.concat(
        F.lit('{"sub":"'), F.col("user_id").cast("string"), F.lit('","exp":'), t.cast("string"), F.when(n % 5 == 0, F.concat(F.lit(',"nbf":'), (t - 86_400).cast("string"))).otherwise(""),
        F.when(n % 11 == 0, ',"iss":"other"').otherwise(',"iss":"desk"'), F.when(n % 13 == 0, ',"aud":"b"').when(n % 2 == 0, ',"aud":["a","b"]').otherwise(',"aud":"a"'), F.lit("}"),
    )
    signed = tokens.sign(F.when(n % 17 == 0, '{"alg":"none"}').otherwise('{"alg":"HS256"}'), claims, TOKEN_KEY)
    token = F.when(n % 19 == 0, F.regexp_replace(signed, r"\.", ".e")).when(n % 23 == 0, F.concat(signed, F.lit("A"))).when(n % 29 == 0, "no.token").otherwise(signed)
    return table(spark, d, "events").select("event_id", F.get(F.split(signed, r"\."), F.lit(2)).alias("signature"), tokens.refusal(token, TOKEN_KEY, F.lit(TOKEN_TIME), "desk", "a").alias("refused"))


def text_search_index(spark, d):
    """Pieces of titles, and digits of phones, looked up in an index of all titles and phones."""
    title = F.lower("title")
    titles = heads(spark, d).select(F.col("doc_id").alias("id"), F.lit("title").alias("part"), title.alias("text"))
    phone = F.concat(F.lit("55119"), F.lpad(F.col("c_custkey").cast("string"), 8, "1"))
    phones = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("phone").alias("part"), phone.alias("text"))
    rows = titles.unionByName(phones)
    index = cut(search.postings(rows), "grams")
    some = titles.where("id % 25 = 0")
    needles = some.select(F.col("id").alias("needle_id"), "part", F.expr("substring(text, 3, 7)").alias("needle")).unionByName(
        some.where("id % 50 = 0").select((F.col("id") + 1).alias("needle_id"), "part", F.expr("substring(text, 1, 2)").alias("needle"))
    )
    digits = phones.where("id % 40 = 0").select(F.col("id").alias("needle_id"), "part", F.expr("right(text, 4)").alias("needle"))
    return search.search(needles.unionByName(digits), index, rows)


def pattern_index(spark, d):
    """Titles with each of some sixty patterns, by the words that the patterns need."""
    packs = [search.Pattern(w, (w,), rf"(?i)(^|[^\p{{L}}\p{{N}}]){w}([^\p{{L}}\p{{N}}]|$)") for w in COMMON]
    packs += [search.Pattern("licence", ("license", "licensed"), "(?i)licensed?( under|$)"), search.Pattern("rights", ("reserved",), "(?i)all rights +reserved")]
    return search.match_patterns(heads(spark, d), packs, "doc_id", "title").withColumnRenamed("id", "doc_id")


def stream_fault_isolation(spark, d):
    """Three streams over the events, of which the second throws at its first batch: what the report and the others' files say."""
    path = f"{work_dir(spark)}/streams-{uuid.uuid4().hex}"

    def start(name, kind):
        def write(batch, number):
            if kind == "error":
                raise ValueError("this stream fails")
            batch.write.mode("overwrite").parquet(f"{path}/{name}/number={number}")

        some = event_stream(spark, d).where(F.col("event_type") == kind).select("event_id", "value")
        return lambda: some.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/{name}-checkpoint").trigger(availableNow=True).start()

    report = supervise.run_streams(spark, {kind: start(kind, kind) for kind in ("click", "error", "view")})
    told = None
    for kind in ("click", "view"):
        rows = spark.read.schema("event_id long, value double").parquet(f"{path}/{kind}/*").agg(F.count(F.lit(1)).alias("written")).select(F.lit(kind).alias("name"), "written")
        told = rows if told is None else told.unionByName(rows)
    return report.join(told, "name", "left").select("name", "state", F.coalesce("written", F.lit(0)).alias("written"))


#: The feeds of the test tables but one, which is counted under other.
FEEDS = [f"src{i}" for i in range(19)]


def composed_run(spark, d):
    return run.radar_run(heads(spark, d), FEEDS).items.select("column", F.col("rank").cast("long").alias("rank"), "doc_id", "id", "url", "title")


def composed_run_report(spark, d):
    return run.radar_run(heads(spark, d), FEEDS).report


def summary_clean(spark, d):
    """Titles as summaries with tags, escaped tags and footers around them, of any length."""
    kind = F.col("doc_id") % 5
    tail = F.when(kind == 0, " [&#8230;]").when(kind == 1, F.concat(F.lit(" Continue reading "), F.repeat(F.lit("a long way "), 30))).when(kind == 2, F.concat(F.lit(" The post "), F.col("source"), F.lit(" appeared first on <b>Desk</b>."))).when(kind == 3, "&lt;br&gt;&lt;i&gt;&lt;/i&gt;").otherwise("")
    raw = F.concat(F.lit("<![CDATA[<p>"), X.escape_html(F.col("title")), F.lit("</p>"), tail, F.lit("]]>"))
    return heads(spark, d).select("doc_id", X.clean_summary(raw).alias("summary"))


def _selected(spark, d):
    """(the selected trends, all scored terms, hits), as written tables."""
    hits = cut(mined_hits(spark, d), "term-hits")
    scored = cut(trends.score_terms(hits, anchor()), "term-scores")
    return trends.suppress_redundant(scored, hits, "place"), scored, hits


def trend_report(spark, d):
    selected, scored, _ = _selected(spark, d)
    return trends.trend_rows(selected, scored)


def trend_items(spark, d):
    selected, _, hits = _selected(spark, d)
    return trends.trend_items(selected, hits)


def item_heat_selected(spark, d):
    selected, _, hits = _selected(spark, d)
    return trends.selected_heat(heads(spark, d), selected, hits)


ALL = [summary_clean, trend_report, trend_items, item_heat_selected, composed_run, composed_run_report, stream_fault_isolation, versioned_upsert, versioned_history, stream_expiring_state, date_parse_zones, token_checks_signed, text_search_index, pattern_index]
