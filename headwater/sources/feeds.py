"""Feeds, pages and embedded snapshots as rows; malformed input gives nulls or an error column, never a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import text as X

SNAPSHOT_SCHEMA = "generatedAt string, items array<struct<id:string,column:string,source:string,title:string,url:string>>"


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, xml, error) of each file below ``path``; bytes are decoded as their declaration says."""
    raw = spark.read.format("binaryFile").load(path)
    body = decode_body(F.col("content"), F.lit(None).cast("string"))
    return raw.select(F.col("_metadata.file_name").alias("name"), body.alias("xml"), F.when(F.length("content") == 0, "empty").alias("error"))


#: The characters of windows-1252 at the places of control characters, by rule from Python's codec.
_C1 = [(chr(i), bytes([i]).decode("cp1252")) for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decode_body(content: Column, content_type: Column) -> Column:
    """Charset of the header, else of the XML declaration, else UTF-8; unknown labels fall back to UTF-8. Labels of
    Latin-1 mean windows-1252, as on the web."""
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    label = F.upper(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=\"?([\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?i)<\?xml[^>]*encoding=[\"']([\w-]+)", 1), F.lit("")), F.lit("UTF-8")))
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in _C1), "".join(b for _, b in _C1))
    wide = [F.when(label == name, F.decode(content, name)) for name in ("UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32")]
    return F.coalesce(F.when(label.isin("ISO-8859-1", "LATIN1", "LATIN-1", "WINDOWS-1252", "CP1252", "US-ASCII", "ASCII"), latin), *wide, F.decode(content, "UTF-8"))


def feed_status(expected: DataFrame, read: DataFrame) -> DataFrame:
    """(name, entries, error): a row for each expected feed, whatever became of it.

    expected: name; read: (name, xml). A feed without a file is "missing", a blank one "empty", one without any entry
    that has a title and a url "no entries". No feed's fault touches another.
    """
    got = expected.select("name").join(read.select("name", "xml", F.lit(True).alias("there")), "name", "left")
    counts = parse_feed(got.select("name", "xml")).groupBy("name").agg(F.count(F.lit(1)).alias("entries"))
    seen = got.select("name", "there", (F.trim(F.coalesce("xml", F.lit(""))) == "").alias("blank")).join(counts, "name", "left")
    entries = F.coalesce("entries", F.lit(0).cast("long"))
    why = F.when(F.col("there").isNull(), "missing").when(F.col("blank"), "empty").when(entries == 0, "no entries")
    return seen.select("name", entries.alias("entries"), why.alias("error"))


def parse_feed(
    df: DataFrame,
    xml_col: str = "xml",
    clean_title: Callable[[Column], Column] = X.clean_title,
    clean_url: Callable[[Column], Column] = X.clean_url,
    complete: bool = True,
) -> DataFrame:
    """One row for each RSS, RDF or Atom entry that has a title and a url, or for every one if not ``complete``: then a
    title without text is empty, and what has no element is null.

    Adds ord, title, url, published (text as given), summary and categories. A tolerant scan by patterns: broken
    entities and unclosed tags inside entries do no harm.
    """
    xml = F.coalesce(F.col(xml_col), F.lit(""))
    atom = xml.rlike(r"(?i)<feed[\s>]") & xml.rlike(r"(?i)<entry[\s>]")
    items = F.when(atom, F.regexp_extract_all(xml, F.lit(r"(?is)<entry\b[^>]*>(.*?)</entry>"), 1)).otherwise(F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1))
    rows = df.select("*", F.posexplode(items).alias("ord", "_entry"))
    entry = F.col("_entry")
    link = F.coalesce(
        X.non_blank(F.regexp_extract(entry, r"(?is)<feedburner:origLink[^>]*>(.*?)</feedburner:origLink>", 1)),
        X.non_blank(F.regexp_extract(entry, r"(?is)<link\b(?=[^>]*rel=[\"']alternate[\"'])[^>]*href=[\"']([^\"']*)[\"']", 1)),
        X.non_blank(F.regexp_extract(entry, r"(?is)<link>(.*?)</link>", 1)),
        X.non_blank(F.regexp_extract(entry, r"(?is)<link\b[^>]*href=[\"']([^\"']*)[\"']", 1)),
        X.non_blank(F.regexp_extract(entry, r"(?is)<(?:guid|id)\b[^>]*>\s*(https?://.*?)\s*</(?:guid|id)>", 1)),
    )
    first = lambda *names: F.coalesce(*[X.non_blank(F.regexp_extract(entry, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1)) for n in names])
    kinds = F.array_union(F.regexp_extract_all(entry, F.lit(r"(?is)<category\b[^>]*>(.*?)</category>"), 1), F.regexp_extract_all(entry, F.lit(r"(?is)<category\b[^>]*term=[\"']([^\"']*)[\"']"), 1))
    out = rows.withColumns({
        "title": F.coalesce(clean_title(first("title")), F.when(entry.rlike(r"(?i)<title\b"), "")),
        "url": clean_url(X.decode_entities(X.unwrap_cdata(link))),
        "published": first("pubDate", "dc:date", "published", "updated"),
        "summary": X.clean_summary(first("description", "summary", "content:encoded", "content")),
        "categories": F.filter(F.transform(kinds, lambda k: X.clean_title(k)), lambda c: c != ""),
    })
    kept = out.where((F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull()) if complete else out
    return kept.drop("_entry")


def embedded_snapshot(html: Column, schema: str = SNAPSHOT_SCHEMA) -> Column:
    """The JSON document in the page's data script; null if it is absent or broken."""
    body = F.regexp_extract(html, r"(?is)<script[^>]*id=[\"']page-data[\"'][^>]*>(.*?)</script>", 1)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def share_image(html: Column) -> Column:
    """The first https image of the head that is no logo or icon, by precedence of its meta name."""
    head = F.split(F.substring(html, 1, 400_000), r"(?i)</head>", 2)[0]
    found = [F.regexp_extract(head, rf"(?is)<meta\b(?=[^>]*(?:property|name)=[\"']{n}[\"'])[^>]*content=[\"']([^\"']*)[\"']", 1) for n in ("og:image:secure_url", "og:image", "twitter:image", "twitter:image:src")]
    secure = [F.regexp_replace(F.regexp_replace(u, "^//", "https://"), "^http://", "https://") for u in found]
    return F.coalesce(*[F.when(u.rlike("^https://") & ~u.rlike(r"(?i)(logo|favicon|sprite|placeholder|avatar)[^/]*$"), u) for u in secure])
