"""Plans of the serving side: feeds' rules as a table, editions, backlog, requests, tokens, labels; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators import curate, trends
from headwater.sources.tables import table

NOW = "2024-01-31 00:00:00"


def entities_full(spark: SparkSession, d: str) -> DataFrame:
    """Named, decimal, hexadecimal, doubly escaped, unknown and invalid entities around each title."""
    raw = F.concat(F.lit("&ccedil;&#231;&#xE7; &amp;eacute; &euro; &nosuch; &#0; a&b "), F.regexp_extract("text", r"^[^\n]*", 0))
    return table(spark, d, "documents").select("doc_id", X.decode_entities(raw).alias("title"))


def date_parse_localised(spark, d):
    names = F.array(*map(F.lit, "jan fevereiro mar. abril maio junho jul ago setembro out nov dezembro".split()))
    month = F.element_at(names, F.month("ts"))
    form = F.concat(F.lit("qua, "), F.dayofmonth("ts").cast("string"), F.lit(" de "), month, F.lit(" de "), F.year("ts").cast("string"), F.date_format("ts", " HH:mm"))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(X.parse_date(form)).alias("epoch"))


def absolute_url(spark, d):
    form = F.when(F.col("page_id") % 5 == 0, "/img/a.png").when(F.col("page_id") % 5 == 1, "//cdn.example/b.png").when(F.col("page_id") % 5 == 2, "c.png").when(F.col("page_id") % 5 == 3, "http://x.example/d.png").otherwise("data:image/png;x")
    return table(spark, d, "pages").select("page_id", X.absolute_url(form, F.col("url")).alias("image"))


def pick_image(spark, d):
    """The widest usable candidate of an entry; pixels are left out; the first of equal ones stays."""
    k = F.col("page_id")
    media = F.concat(F.lit('<media:content url="https://m.example/'), k.cast("string"), F.lit('.jpg" width="'), (k % 7 * 100).cast("string"), F.lit('"/><media:thumbnail url="https://m.example/t.jpg" width="300"/><enclosure url="https://m.example/pixel.gif" width="900"/>'))
    tags = F.regexp_extract_all(media, F.lit(r"<(?:media:content|media:thumbnail|enclosure)\b[^>]*>"), 0)
    found = F.transform(tags, lambda t, i: F.struct(F.coalesce(F.regexp_extract(t, r'width="(\d+)"', 1).try_cast("int"), F.lit(0)).alias("w"), (-i).alias("i"), F.regexp_extract(t, r'url="([^"]*)"', 1).alias("url")))
    fit = F.filter(found, lambda c: ~c["url"].rlike(r"(?i)pixel|spacer|blank") & c["url"].startswith("https://"))
    return table(spark, d, "pages").select("page_id", F.array_max(fit)["url"].alias("image"))


def feed_rules(spark, d):
    """Each feed's own patterns, joined as a table: what its titles and urls must and must not match."""
    rules = spark.createDataFrame([("src1", None, "(?i)ll", None), ("src2", "(?i)a", None, None), ("src3", None, None, "/1[0-9]*$")], "source string, include string, exclude string, exclude_url string")
    h = curate.headlines(table(spark, d, "documents")).join(F.broadcast(rules), "source", "left")
    hit = lambda c, p: F.coalesce(F.regexp_like(c, p), F.lit(False))
    why = F.when(hit("url", F.col("exclude_url")), "noise").when(F.col("include").isNotNull() & ~hit("title", F.col("include")), "not_included").when(hit("title", F.col("exclude")), "excluded").otherwise("kept")
    return h.groupBy("source", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def edition_latest(spark, d):
    """The last edition by its id, the ISO week."""
    week = X.iso_week(F.col("ts"))
    n = table(spark, d, "events").groupBy(week.alias("id")).agg(F.count(F.lit(1)).alias("items"), F.max("value").alias("heat"))
    return n.orderBy(F.desc("id")).limit(1)


def pending_backlog(spark, d):
    """Rows that wait for their sync for over two minutes, the oldest first, a batch of twenty."""
    o = table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp") - F.expr("interval 2 minutes")))
    return o.orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", F.unix_timestamp("o_orderdate").alias("updated_at"))


def sync_updates(spark, d):
    """Success clears the error and sets the mark; failure keeps the mark empty and stores a short error."""
    ok, bad = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    synced = F.when(ok, F.unix_timestamp("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", synced.alias("synced_at"), F.when(bad, F.substring(F.concat(F.lit("failed: "), "o_orderpriority"), 1, 12)).alias("sync_error"))


def schedule_bounds(spark, d):
    """Later than a minute and not later than thirty days from now."""
    now = F.lit(NOW).cast("timestamp")
    fine = (F.col("ts") > now - F.expr("interval 15 days") + F.expr("interval 60 seconds")) & (F.col("ts") <= now + F.expr("interval 15 days"))
    return table(spark, d, "events").groupBy(fine.alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def text_search(spark, d):
    """Titles or sources that hold the words, whatever their case: the newest 80, which is the feature."""
    h = curate.headlines(table(spark, d, "documents"))
    found = h.where(F.lower(F.concat_ws(" ", "title", "source")).contains("de"))
    return found.orderBy(F.desc("date"), "doc_id").limit(80).select("doc_id", "title")


def token_claims(spark, d):
    """Claims of a token's middle part: purpose and expiry; a broken token gives nulls and is refused."""
    body = F.concat(F.lit('{"purpose":"'), F.when(F.col("event_id") % 3 == 0, "login").otherwise("read"), F.lit('","exp":'), F.unix_timestamp("ts").cast("string"), F.lit("}"))
    token = F.when(F.col("event_id") % 7 == 0, "x.!!.z").otherwise(F.concat(F.lit("h."), X.base64url_encode(body), F.lit(".s")))
    claims = F.from_json(X.base64url_decode(F.get(F.split(token, r"\."), 1)), "purpose string, exp long")
    fine = (claims["purpose"] == "login") & (claims["exp"] > F.unix_timestamp(F.lit("2024-01-15").cast("timestamp")))
    return table(spark, d, "events").select("event_id", claims["purpose"].alias("purpose"), claims["exp"].alias("exp"), F.coalesce(fine, F.lit(False)).alias("accepted"))


def cookie_lookup(spark, d):
    header = F.concat(F.lit("a=1; session="), "props", F.when(F.col("event_id") % 2 == 0, "; lang=pt").otherwise(""))
    return table(spark, d, "events").select("event_id", X.cookie(header, "lang").alias("lang"), X.cookie(header, "a").alias("a"))


def week_label(spark, d):
    return table(spark, d, "events").groupBy(X.week_label(F.col("ts")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def name_parts(spark, d):
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "  da Silva").otherwise(""))
    p = X.name_parts(F.when(F.col("c_custkey") % 9 == 0, "").otherwise(name))
    return table(spark, d, "customer").select("c_custkey", p["first"].alias("first"), p["rest"].alias("rest"), p["initials"].alias("initials"))


def edition_items(spark, d):
    """Items of an edition: names of columns and sources looked up, texts clipped, rows without title or http url dropped."""
    names = spark.createDataFrame([("en", "English"), ("fr", "French")], "column string, column_name string")
    h = curate.headlines(table(spark, d, "documents")).join(F.broadcast(names), "column", "left")
    url = F.when(F.col("url").rlike("(?i)^https?://"), F.col("url"))
    return h.where((F.coalesce("title", F.lit("")) != "") & url.isNotNull()).select("doc_id", F.coalesce("column_name", F.lit("")).alias("column_name"), F.substring("title", 1, 40).alias("title"), F.substring("summary", 1, 60).alias("summary"), url.alias("url"))


def request_validation(spark, d):
    """Batches of up to 25 items with bounded titles and summaries; else the first thing wrong."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("longest"), F.count_if(F.col("text").isNull()).alias("missing"))
    error = F.when((F.col("n") < 1) | (F.col("n") > 25), "items").when(F.col("missing") > 0, "text").when(F.col("longest") > 600, "length")
    return turns.select("conv_id", F.coalesce(error, F.lit("ok")).alias("verdict"))


def used_sources(spark, d):
    h = curate.headlines(table(spark, d, "documents"))
    return h.where(curate.reason(h).isNull()).select("source", X.slugify(F.col("source")).alias("slug")).distinct()


def version_probe(spark, d):
    """The snapshot's time, read from a page without parsing its document; null where there is none."""
    page = F.concat(F.lit('<script id="page-data">{"generatedAt":"2024-01-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('T00:00:00Z","items":['))
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(F.when(F.col("page_id") % 4 > 0, page).otherwise(F.col("html")), r'"generatedAt"\s*:\s*"([^"]+)"', 1), F.lit("")).alias("version"))


def trend_lookback(spark, d):
    h = curate.headlines(table(spark, d, "documents")).select("doc_id", "date")
    return trends.lookback(h, F.lit(curate.ANCHOR).cast("timestamp")).select("doc_id")


def inference_metrics(spark, d):
    """Cached, translated and dropped rows of a run."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "cached").when(F.length("text") % 5 == 0, "dropped").otherwise("translated")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


ALL = [entities_full, date_parse_localised, absolute_url, pick_image, feed_rules, edition_latest, pending_backlog, sync_updates, schedule_bounds, text_search, token_claims, cookie_lookup, week_label, name_parts, edition_items, request_validation, used_sources, version_probe, trend_lookback, inference_metrics]
