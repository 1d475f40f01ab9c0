"""Exactness of the shared parts, and the pipeline against a brute-force version."""

import re

import numpy as np
import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietfield.llm import common, components, encoding, exact_dedup, host_rules, html_text

SF = f"{DATA}/sf0.001"
ALPHABET = st.sampled_from(list("abTé .,'s12%\n\t İ́日² ") + ["  ", "'ll ", " the", "<|endoftext|>"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, mine = Tokenizer.from_file(path), encoding.Encoder(path, keep=50)

    anything = st.text(st.characters(exclude_categories=["Cs"]), max_size=25)  # all of Unicode

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(ALPHABET, max_size=30).map("".join) | anything | st.tuples(anything, st.lists(ALPHABET, max_size=9).map("".join)).map("".join), max_size=4))
    def check(texts):
        want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert mine.encode(texts) == want

    check()


def test_encoder_cuts_only_files_that_it_knows(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other))
    mine = encoding.Encoder(str(tmp_path / "other.json"))
    assert not mine.known_kind and mine.units("a text of words") == ["a text of words"]
    assert mine.encode(["a text of words"]) == mine.library(["a text of words"])
    assert all(encoding.Encoder(public_tokenizers.path(n)).known_kind for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[100 + k] for k in range(60)} == {100} and {found[200 + k] for k in range(3)} == {200} and 300 not in found
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_reach_every_row_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    out = common.with_groups(rows, groups, "k", ["id"])
    assert out.count() == 5000 and out.where("n = 3000").count() == 3000


def test_exact_duplicates(spark, odd_docs):
    rows = exact_dedup.exact_duplicates(odd_docs).toPandas()
    by_digest = exact_dedup.exact_duplicates(odd_docs, digest=lambda t: F.lit("all alike")).toPandas()
    key = lambda f: sorted((str(r.doc_id), str(float(r.keep_id)), r.group_size, r.kept) for r in f.itertuples())
    assert key(rows) == key(by_digest)  # full texts decide where digests do not
    assert key(rows)[:3] == [("1.0", "1.0", 3, True), ("2.0", "1.0", 3, False), ("3.0", "3.0", 2, True)] and ("nan", "1.0", 3, False) in key(rows)
    assert sum(r[3] for r in key(rows) if r[0] == "5.0") == 1  # one of the repeated rows
    odd_docs = odd_docs.withColumns({"_gone_file": F.lit("x"), "_gone_row": F.lit(0), "_file": F.lit("y"), "_row": F.lit(1)})
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_dedup_meets_state_in_later_batches_and_runs(spark, tmp_path):
    first = [(i, f"text {i % 7}") for i in range(40, 60)]
    second = [(3, "text  1"), (4, "new"), (70, "text 5"), (71, "new")]
    a, b = (common.placeable(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) for rows in (first, second))
    state = f"file://{tmp_path}/kept"
    for rows in (exact_dedup.exact_duplicates(a, state=state, batches=3).collect(), exact_dedup.exact_duplicates(a).collect()):
        want = {i: min(j for j, _ in first if j % 7 == i % 7) for i, _ in first}
        assert {r.doc_id: r.keep_id for r in rows} == want and sum(r.kept for r in rows) == 7
    assert len({r.path for r in spark.read.parquet(f"{state}/entries/*").select(F.col("_metadata.file_path").alias("path")).selectExpr("regexp_extract(path, 'batch=([0-9]+)', 1) AS path").distinct().collect()}) == 3
    again = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(b, state=state, earlier=a).collect()}
    assert again == {3: (3, True), 4: (4, True), 70: (40, False), 71: (4, False)}


def test_dedup_run_is_started_again_and_needs_earlier_texts(spark, tmp_path, monkeypatch):
    table = lambda rows: common.placeable(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    a, b = table([(1, "text a"), (2, "text b"), (5, "text  a")]), table([(7, "text a"), (8, "text c"), (9, "text c")])
    state, facts = f"file://{tmp_path}/kept", lambda df: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}
    want = {1: (1, 2, True), 2: (2, 1, True), 5: (1, 2, False)}

    def breaks(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the digests are written, then after the stream has counted them
        m.setattr(exact_dedup, "register", breaks)
        with pytest.raises(RuntimeError):
            exact_dedup.exact_duplicates(a, state=state, run="one")
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "at_places", breaks)
        with pytest.raises(RuntimeError):
            exact_dedup.exact_duplicates(a, state=state, run="one")
    for _ in range(2):
        assert facts(exact_dedup.exact_duplicates(a, state=state, run="one")) == want
    for wrong in (None, table([(3, "text z")])):
        with pytest.raises(ValueError, match="earlier"):
            exact_dedup.exact_duplicates(b, state=state, run="two", earlier=wrong)
    later = exact_dedup.exact_duplicates(b, state=state, run="two", earlier=a)
    assert facts(later) == {7: (1, 3, False), 8: (8, 2, True), 9: (8, 2, False)}
    read = []  # what the third run reads of the state: nothing of the runs before it
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "with_groups", lambda rows, groups, *args: (read.extend([*rows.inputFiles(), *groups.inputFiles()]), common.with_groups(rows, groups, *args))[1])
        assert facts(exact_dedup.exact_duplicates(table([(11, "text d")]), state=state, run="three", earlier=a.unionByName(b))) == {11: (11, 1, True)}
    assert read and not [f for f in read if "/light/one/" in f or "/light/two/" in f or "/entries/batch=0/" in f]
    with pytest.raises(ValueError, match="name"):
        exact_dedup.exact_duplicates(a, state=state, run="../x")


def test_places_beyond_the_bound(spark, odd_docs):
    docs = common.placeable(odd_docs)
    at = common.cut(common.with_places(docs, docs["doc_id"]).where("doc_id IN (1, 5) OR doc_id IS NULL").select("_file", "_row"))
    few, many = (common.without_places(docs, at, n) for n in (100, 2))
    ids = lambda d: sorted(str(r.doc_id) for r in d.collect())
    assert ids(few) == ids(many) and few.count() == 7 and few.columns == odd_docs.columns
    rows = common.with_places(docs, docs["doc_id"])
    for how, n in (("inner", 4), ("left", 11)):
        assert ids(common.at_places(rows, at, how, 100)) == ids(common.at_places(rows, at, how, 2)) and common.at_places(rows, at, how, 2).count() == n


def test_dedup_state_outlives_a_run(spark, tmp_path):
    schema = "digest string, id long, _file string, _row long"
    for k, rows in enumerate(([("a", 5, "f", 0), ("b", 6, "f", 1)], [("a", 3, "g", 0), ("c", 9, "g", 1)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        exact_dedup.register(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
        last = spark.read.parquet(f"{tmp_path}/out/*").groupBy("digest").agg(F.min("keeper").alias("k"), F.max("group_size").alias("n"))
        found = {r.digest: (r.k.id, r.n) for r in last.collect()}
    assert found == {"a": (3, 2), "b": (6, 1), "c": (9, 1)}


def slow_repeats(text):
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_repeated_words(spark):
    rng = np.random.default_rng(4)
    texts = ["", "a", "a a a", "a b c", "a b c a b c", "x " * 50, " a b c  a b c d "] + [" ".join(rng.choice(list("abcd"), n)) for n in (5, 20, 60, 200)] + [" ".join(rng.choice([f"w{i}" for i in range(40)], 3000))]
    rows = host_rules.measures(spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert [r.n_repeat_words for r in sorted(rows, key=lambda r: r.id)] == [slow_repeats(t) for t in texts]


def host_rows(spark, hosts):
    rows = [(h, i < k, i < k // 3, False, False) for h, n, k in hosts for i in range(n)]
    return spark.createDataFrame(rows, "host string, short boolean, repeats boolean, symbols boolean, dup_lines boolean")


def test_hosts_fail_by_rule_and_small_ones_are_shrunk(spark):
    found = host_rules.host_rates(host_rows(spark, [("big", 1000, 900), ("one", 1, 1), ("good", 1000, 50), *[(f"h{k}", 60, 6) for k in range(20)]])).toPandas().set_index("host")
    assert found.host_short["big"] == 900 and found.rate_short["big"] == pytest.approx(0.9, abs=0.01) and found.rate_short["one"] < 0.5
    assert found.index[~found.host_ok].tolist() == ["big"] and (found.host_symbols == 0).all()


def test_hosts_that_differ_by_chance_alone_have_the_mean_rate(spark):
    rng = np.random.default_rng(1)
    found = host_rules.host_rates(host_rows(spark, [(f"h{k}", 10, int(rng.binomial(10, 0.2))) for k in range(60)]), ["short"]).toPandas()
    assert found.rate_short.std() < 0.03 < (found.host_short / found.host_docs).std() and found.host_ok.all()
    whole = host_rules.host_rates(host_rows(spark, [("a", 5, 5), ("b", 3, 3)]), ["short"]).toPandas()
    assert (whole.rate_short == 1).all() and not whole.host_ok.any()
    assert host_rules.host_rates(host_rows(spark, [("a", 1, 0)]).limit(0)).count() == 0


def test_a_failing_host_takes_its_good_documents(spark):
    good = lambda i: " ".join(f"x{i}y{k}" for k in range(60))
    rows = [(i, "short text" if i % 10 else good(i), "bad") for i in range(100)] + [(i, good(i), f"h{i % 9}") for i in range(100, 400)]
    found = host_rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert not found.kept[found.host == "bad"].any() and found.kept[found.host != "bad"].all() and (~found.base_failed & (found.host == "bad")).sum() == 10


PAGES = {
    "<p>one</p><div class='sidebar'>links here</div><p>two and some more words</p>": "two and some more words",
    "<html><head><title>T</title></head><body><nav>menu a b</nav><main><h1>Head</h1><p>Some text &amp; more&nbsp;text<br>here</p><aside>ad ad</aside><p>end</p></main><footer>foot</footer></body></html>": "Head\nSome text & more text here\nend",
    "<article><header><h1>Title of it</h1></header><p>body of text</p><form><input>subscribe now</form><section id='comments'><p>first reader</p></section></article>": "Title of it\nbody of text",
    "<script>var a = '<p>no</p>';</script><!-- <p>no</p> --><p>yes it is</p><style>p{}</style><p>unclosed": "yes it is\nunclosed",
    "<p>" + "\u0130" * 30 + "</p><script>x</script><p>after text here words which must be kept</p>": "\u0130" * 30 + "\nafter text here words which must be kept",
    "<SCRIPT>no</Script ><P>Straße ſ text</P><style>\u212a</STYLE><p>end of it</p>": "Straße ſ text\nend of it",
    "<div id=main class='content has-sidebar'><p>the text of the page</p></div>": "the text of the page",
    "<nav><a>home page</a><main><p>the text of it</p></main>": "the text of it",
    "<article><p>first article text</p></article>" + "<div></div>" * 10 + "<article><p>second article text that is longer</p></article>": "first article text\nsecond article text that is longer",
    "<article><h1>a heading</h1>" + "<img>" * 60 + "<p>the text of the article</p></article>": "a heading\nthe text of the article",
    "<article><p>let <math><mi>x</mi></math> be <svg><text>drawn</text></svg></p><noscript>seen without</noscript> <object>fallback</object></article>": "let x be drawn\nseen without fallback",
    "<title>a <nav> b</title><p>text of the page</p>": "text of the page",
    "<body><header><h1>Site</h1></header><div class=post><p>some post text here</p><div class=share><a>tweet</a></div></div><div class=related><p>other posts you like</p></div></body>": "some post text here",
    "<article><p>the long story</p><div class=ad>buy this now</div><p>goes on</p></article>": "the long story\ngoes on",
    "": "", "<p></p>": "", "plain words only": "plain words only", "<div class=cookie-notice>we use cookies</div><ul><li>a b c</li><li>d e f</li></ul>": "a b c\nd e f",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


@given(st.text(alphabet="<>/abp \"'=!-&;", max_size=80))
@settings(max_examples=300, deadline=None)
def test_main_text_takes_any_markup(page):
    assert html_text.main_text(page) == html_text.main_text(page)


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run(scores):
    first, end = html_text.best_run([float(s) for s in scores])
    sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    assert sum(scores[first:end]) == max([0, *sums])


def test_layouts_never_seen_are_read_right():
    wrong = 0
    for page, _ in html_text.labelled_pages(200, seed=99):  # not the seed that weights are learnt from
        inside = re.findall(f"{html_text.ON}(.*?){html_text.OFF}", page, re.S)
        want = re.sub("<[^>]*>", " ", " ".join(inside)).split()
        wrong += html_text.main_text(re.sub(f"[{html_text.ON}{html_text.OFF}]", "", page)).split() != want
    assert wrong <= 8
    learnt = html_text.weights()
    assert learnt["<nav>"] < 0 < learnt["<article>"] and learnt["sidebar"] < 0 < learnt["content"]


def test_pipeline(spark, tables):
    import corpus_pipeline
    from test_similar import classes

    from quietfield.llm import langid, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, seen, SF))
        before, after = seen.toPandas(), out.toPandas()
        assert list(after.columns) == columns
        ids = set(before.doc_id)
        if name == "language_id":
            want = {d.doc_id for d in before.itertuples() if langid.counts(d.text) is not None}
        elif name == "exact_dedup":
            want = set(before.assign(t=before.text.str.replace(r"[ \t-\r]+", " ", regex=True)).groupby("t").doc_id.min())
        elif name == "simhash_near_dedup":
            before = before.sort_values("doc_id")
            want = {before.doc_id.iloc[k] for k in set(classes(before.text.tolist()))}
            assert len(want) < len(before)
        else:
            rows = mixing.mixture(seen).toPandas()
            want = set(rows.id[rows.sampled])
        assert set(after.doc_id) == want <= ids and len(after) == len(want)
        seen = out
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(seen.toPandas().doc_id)


def test_pipeline_over_odd_and_empty_tables(spark, tables):
    import corpus_pipeline

    full, empty = tables
    kept = [{1, 5, 6, 8, 9}, {1, 5, 6, 8, 9}, {1, 5, 6, 8, 9}]  # letters; equal texts once; nothing else alike
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], [{None, 1, 2, 5, 6, 8, 9}, *kept[:2]], strict=True):
        out = common.cut(stage(spark, docs, full))
        assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns
        docs = out
    assert docs.count() == 5
    mixed = common.cut(corpus_pipeline.mix_sources(spark, docs, full))
    assert {r.doc_id for r in mixed.collect()} <= kept[2] and mixed.columns == docs.columns
    pieces = corpus_pipeline.pack_sequences(spark, mixed, full).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in mixed.collect()} and (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    none = corpus_pipeline.run(spark, empty)
    assert none.count() == 0 and none.columns == list(pieces.columns)


def test_pipeline_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline

    long = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(3, long[0]), (5, long[0] + " end"), (5, long[1]), (None, long[2]), (None, long[2] + " end"), (None, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(str(r.doc_id) + r.text[:2] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == ["3a0", "5b0", "Nonec0", "Noneon"]


def test_main_text_takes_a_time_in_proportion_to_the_page():
    import time

    took = {}
    for n in (2_000, 20_000):
        began = time.perf_counter()
        rows = html_text.main_text("<article><table>" + "<tr><td>cell text" * n + "</table></article>")
        deep = html_text.main_text("<article>" + "<div class='x'><b>word</b>" * n + "</article>")
        other = html_text.main_text("<article><p>one two three</p>" + "<section class=a1><span></nav></ul>word" * n + "</article>")
        took[n] = time.perf_counter() - began
        assert rows.count("cell text") == n and deep.count("word") == n and other.count("word") == n
    assert took[20_000] < 40 * took[2_000] + 1  # ten times the page; quadratic time would be a hundred times


def test_one_word_of_a_class_does_not_empty_a_page():
    assert html_text.main_text("<article class='comments-open'><p>Real article text goes here</p></article>") == "Real article text goes here"
    assert html_text.main_text("<main id='related'><article><p>Text of the page</p></article></main><footer><p>imprint</p></footer>") == "Text of the page"
    assert html_text.main_text("<nav><a>home</a></nav><form><input></form>") == ""
