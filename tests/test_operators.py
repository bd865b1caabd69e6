import random

import pytest
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators import curate, enrich, state, trends
from headwater.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("https://Site.example/a/?utm_source=x#top", "https://site.example/a"), ("https://site.example/a/?p=1&ref=z", "https://site.example/a/?p=1"), ("no url", "no url")])
def test_clean_url(spark, raw, want):
    assert one(spark, X.clean_url(F.lit(raw))) == want


def test_text_functions(spark):
    assert one(spark, X.normalize_title(F.lit(" Ação, É 9! "))) == "acao e 9"
    assert one(spark, X.clean_title(F.lit("<b>A</b> &lt;i&gt; &amp;amp; B"))) == "A <i> & B"
    assert one(spark, X.truncate(F.lit("one two three four five"), 14)) == "one two three…"
    assert one(spark, X.csv_cell(F.lit('=1;"x"'))) == "\"'=1;\"\"x\"\"\""
    assert one(spark, X.phone_e164(F.lit("0055 (11) 91234-5678"))) == "+5511912345678"
    assert one(spark, X.iso_week(F.lit("2027-01-01").cast("timestamp"))) == "2026-W53"
    assert one(spark, F.unix_timestamp(X.parse_date(F.lit("Tue, 02 Jan 2024 03:04:05 +0000")))) == 1704164645
    assert one(spark, X.parse_date(F.lit("soon"))) is None


def greedy(rows):
    a, b, out = set(), set(), []
    for o, x, y in sorted(rows):
        if x not in a and y not in b:
            out.append(o)
            a.add(x)
            b.add(y)
    return out


def test_dedup_is_greedy(spark):
    rng = random.Random(3)
    for n in (40, 120):
        rows = [(i, rng.randint(0, n // 4), rng.randint(0, n // 4)) for i in range(n)]
        got = curate.dedup_first_wins(spark.createDataFrame(rows, "o long, x long, y long"), "o", ("x", "y"))
        assert sorted(r.o for r in got.collect()) == greedy(rows)
    assert curate.dedup_first_wins(spark.createDataFrame([], "o long, x long, y long"), "o", ("x", "y")).count() == 0


def test_gate_keeps_previous_snapshot(spark, tmp_path):
    path = f"{tmp_path}/snap"
    assert curate.gated_write(spark.range(50), path) == 50
    with pytest.raises(ValueError):
        curate.gated_write(spark.range(3), path)
    assert spark.read.parquet(path).count() == 50


def test_feeds(spark):
    rss = "<rss><item><title>A &amp; <b>B</b></title><link>https://x.example/a/?utm_medium=r</link><category>c1</category><br></item><item><title>No link</title></item></rss>"
    atom = "<feed><entry><title type='html'>T</title><link rel='self' href='https://x.example/self'/><link rel='alternate' href='https://x.example/alt'/><published>2024-01-01</published></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("n", None), ("e", "")], "name string, xml string")
    got = {(r.name, r.title, r.url, r.published, tuple(r.categories)) for r in feeds.parse_feed(df).collect()}
    assert got == {("r", "A & B", "https://x.example/a", None, ("c1",)), ("a", "T", "https://x.example/alt", "2024-01-01", ())}


def test_pages(spark):
    html = '<head><meta content="http://x.example/logo.png" property="og:image"><meta name="twitter:image" content="//x.example/p.jpg"></head><script id="page-data">{"generatedAt":"t","items":[{"id":"1"}]}</script>'
    assert one(spark, feeds.share_image(F.lit(html))) == "https://x.example/p.jpg"
    assert one(spark, feeds.embedded_snapshot(F.lit(html))["generatedAt"]) == "t"
    assert one(spark, feeds.embedded_snapshot(F.lit("<p>"))) is None
    assert one(spark, feeds.decode_body(F.lit("é".encode("latin-1")), F.lit("text/xml; charset=iso-8859-1"))) == "é"
    assert one(spark, feeds.decode_body(F.lit("é".encode()), F.lit("text/xml; charset=odd"))) == "é"


def test_batches_and_retry(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(1)
        if len(texts) > 10:
            raise RuntimeError("too many")
        return [t + "!" if t != "bad" else None for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(20)], "id long, t string").coalesce(1)
    got = {r.id: (r.output, r.tries) for r in enrich.batched_inference(rows, model, "id", "t").collect()}
    assert got[0] == ("t0!", 2) and got[3] == (None, 2) and len(got) == 20
    assert asked.value == 3


def test_upsert_keeps_first_and_merges(spark):
    cols = "id long, seq long, ts timestamp, title string, image string, url string, heat double"
    rows = [(1, 1, None, "a", "i1", "u1", 5.0), (1, 2, None, "b", "", "u2", 3.0), (2, 3, None, "c", None, "u3", 1.0)]
    got = {r.id: (r.title, r.image, r.url, r.heat) for r in state.upsert_news(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("b", "i1", "u1", 5.0), 2: ("c", None, "u3", 1.0)}


def test_one_source_is_no_trend(spark):
    hits = spark.createDataFrame([(f"{i}", "s1" if t == "x" else f"s{i}", "en", t) for i in range(3) for t in ("x", "y")], "id string, source string, column string, term string").withColumn("date", F.current_timestamp())
    assert [r.term for r in trends.trend_scores(hits, F.current_timestamp()).collect()] == ["y"]


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_restart(spark, tmp_path):
    """A start with nothing new returns the version that is there."""
    from headwater.plans import queries
    from headwater.streaming import micro_batches

    source = lambda: queries.news_stream(spark, "/root/testdata/sf0.001")
    first = micro_batches.upsert_stream(spark, source(), f"{tmp_path}/s")
    again = micro_batches.upsert_stream(spark, source(), f"{tmp_path}/s")
    assert again.versions() == first.versions() and again.manifest() == first.manifest() and again.read().count() > 0


def test_gate_keeps_the_snapshot(spark, tmp_path):
    path = f"{tmp_path}/snap"
    assert curate.gated_write(spark.range(50), path) == 50
    with pytest.raises(ValueError):
        curate.gated_write(spark.range(10), path)
    assert spark.read.parquet(path).count() == 50
    assert curate.gated_write(spark.read.parquet(path).where("id < 45"), path) == 45
    assert spark.read.parquet(path).count() == 45


def test_feed_text_cases(spark):
    assert one(spark, X.decode_entities(F.lit("&ccedil;&#231;&#xe7; &amp;amp; &#0; &zzz; a & b"))) == "ççç &  &zzz; a & b"
    assert one(spark, X.clean_url(F.lit("https://a.example/x?UTM_SOURCE=1"))) == "https://a.example/x"
    assert one(spark, X.phone_e164(F.lit("+1 415 555 2671"))) == "+14155552671"
    assert one(spark, F.unix_timestamp(X.parse_date(F.lit("seg, 02 de fevereiro de 2024 03:04")))) == 1706843040
    assert one(spark, X.base64url_decode(X.base64url_encode(F.lit("é?>~ x")))) == "é?>~ x"
    assert one(spark, X.base64url_decode(F.lit("!!"))) is None
    assert one(spark, X.absolute_url(F.lit("a.png"), F.lit("http://s.example/d/e?q#f"))) == "https://s.example/d/a.png"


def test_edition_falls_back_to_the_hottest(spark):
    c = spark.createDataFrame([(i, float(i)) for i in range(12)], "item_id int, heat double")
    few = spark.createDataFrame([(1, 5), (99, 1), (1, 2)], "item_id int, pos int")
    assert [r.item_id for r in state.weekly_edition(c, few).orderBy("pos").collect()] == list(range(11, 3, -1))
    assert state.weekly_edition(c.limit(2), few).count() == 0


def test_names_in_titles(spark):
    """Runs, known words, first words and sources that write all words with capitals."""
    rows = [(1, "a", "The new OpenAI Labs meet Ana Lima: Rio"), (2, "b", "Lima wins again"), (3, "c", "Big Day For YouTube And Red"), (4, "d", "")]
    items = spark.createDataFrame(rows, "doc_id long, source string, title string")
    shout = spark.createDataFrame([("c", True), ("a", False)], "source string, title_case boolean")
    got = {}
    for r in trends.mined_terms(items, shout).collect():
        got.setdefault(r.doc_id, set()).add(r.term)
    assert got == {1: {"OpenAI Labs", "OpenAI", "Labs", "Ana Lima", "Ana", "Lima", "Rio"}, 2: {"Lima"}, 3: {"YouTube"}}
    assert trends.mined_terms(items.limit(0), shout).count() == 0


def test_suppression_reads_in_chunks(spark):
    """Kept terms are the same whatever the chunk."""
    rng = random.Random(5)
    sets = {f"t{i:02}": frozenset(rng.sample(range(12), rng.randint(2, 5))) for i in range(40)}
    scored = spark.createDataFrame([(t, len(s), 2, float(len(s))) for t, s in sets.items()], "term string, count long, sources long, score double")
    hits = spark.createDataFrame([(t, str(i)) for t, s in sets.items() for i in s], "term string, id string")
    kept = []
    for t in sorted(sets, key=lambda t: (-len(sets[t]), t)):
        if len(kept) < 6 and all(len(sets[t] & sets[k]) / min(len(sets[t]), len(sets[k])) < 0.8 for k in kept):
            kept.append(t)
    for chunk in (3, 100):
        assert [r.term for r in trends.suppress_redundant(scored, hits, limit=6, chunk=chunk).orderBy("rank").collect()] == kept


def test_restored_case(spark):
    mend = lambda a, b: one(spark, enrich.restore_case(F.lit(a), F.lit(b), frozenset(["meta"])))
    assert mend("TikTok and Meta sue Altman", "tiktok e meta processam altman") == "TikTok e meta processam Altman"
    assert mend("iOS is out", "ios chegou") == "iOS chegou"
    assert mend("", "x") == "x" and mend("A", "") == ""


def test_caches_and_exports(spark, tmp_path):
    from headwater.sources import tables

    assert tables.read_cache(spark, f"{tmp_path}/none", "k string, v string").count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"k": "1", "v": "x"}\n{oops\n')
    assert [tuple(r) for r in tables.read_cache(spark, f"{tmp_path}/c", "k string, v string").collect()] == [("1", "x")]
    rows = spark.createDataFrame([("=1", 'a"b')], "a string, b string")
    tables.export_lines(rows, X.csv_line(F.col("a"), F.col("b")), "a;b", f"{tmp_path}/e")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "e").glob("part-*"))).decode()
    assert text == "\ufeffa;b\r\n'=1;\"a\"\"b\"\r\n"
