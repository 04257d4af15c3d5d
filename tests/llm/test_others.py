import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from talentloom.llm import chat_format, quality, url_filter, warc


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.op2_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(p == 1 for y, p in held if y == 1)


def test_votes_are_those_of_all_neighbours():
    import numpy as np

    rng = np.random.default_rng(5)
    counts = rng.poisson(0.2, (40, quality.TRIGRAMS + 8)).astype(np.float32)
    labels = rng.integers(0, 2, 40)
    space = quality.Space(counts[:30], labels[:30], 8)
    got = space.vote(counts[30:], 5, block=3)
    v = quality.unit(quality.weighted(counts[30:], space.idf) @ space.axes)
    for x, s in zip(v, got):
        cosines = np.array([float(x @ p) for p in space.points])
        near = np.argsort(-cosines)[:5]
        w = np.maximum(cosines[near], 1e-6)
        assert s == pytest.approx((w * labels[:30][near]).sum() / w.sum(), abs=1e-5)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (8, None)], "doc_id long, quality int")
    space = quality.fit(odd, labels)
    got = quality.score(odd, space)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns)
    assert quality.score(none, space).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_url_rules(spark):
    urls = ["https://Www.Example.COM/en/7x?a#b", "http://example.com/en/8", "a://x.net/de/1", "a://example.net/de/81", "a://org/es/", "a://xorg/es/", "nothing", None, "a://b.net?de/://c", "a://com/EN/", "q://u.example.com/en/7://"]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    rules = ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None, "example.com/en/7"]
    assert [got[i].rule for i in range(len(urls))] == rules
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/7x") and (got[6].host, got[7].path) == ("", "") and (got[8].host, got[8].path) == ("b.net", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}


def test_urls_without_rules(spark):
    rows = spark.createDataFrame([(1, "a://x/y"), (1, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.url_verdicts(rows).collect()} == {"allow"}
    assert url_filter.url_verdicts(rows.limit(0)).count() == 0


def test_trees_judge_urls_they_have_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = url_filter.url_verdicts(pages).join(pages.select("page_id", "url"), "page_id").filter(F.col("rule").isNotNull() & url_filter.held_out(F.col("url"))).collect()
    right = sum((r.block_score >= 0.5) == (r.verdict == "block") for r in held)
    most = max(sum(r.verdict == v for r in held) for v in ("block", "allow"))
    print("held out", len(held), "right", right, "majority", most)
    assert len(held) > 100 and right > most


def test_url_rules_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", F.lit("clash").alias("host"), F.lit(1).alias("rule"), F.lit(2).alias("fold"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages).collect()}
    rows = pages.select("page_id", "url").collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = "", ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(x), x, v) for v, x in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert got[r.page_id][:3] == (host, path, rule) and got[r.page_id][3] in ((verdict,) if rule else ("allow", "block"))


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "<html><head><title>T &amp; U</title></head><body><p>One<br>two &lt;3</p><a class=x href=\"/b\">b</a></body></html>", "clash"), (2, None, None, None), (None, "u", "plain", None)], "page_id long, url string, html string, header string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6 and warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    own = {r.record_type: r for r in rows if r.page_id == 1}
    assert own["conversion"].block == "One\ntwo <3\nb"
    assert "title: T &amp; U" in own["metadata"].block and "outlink: /b L a/@href" in own["metadata"].block and "http-header-content-type: text/html; charset=utf-8" in own["metadata"].block
    for kind, r in own.items():
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"WARC-Block-Digest: sha256:{hashlib.sha256(r.block.encode()).hexdigest()}\r\n" in r.header
        other = own["metadata" if kind == "conversion" else "conversion"]
        assert f"WARC-Concurrent-To: {other.record_id}\r\n" in r.header and f"Content-Length: {len(r.block.encode())}\r\n" in r.header


def test_character_references(spark):
    texts = {"a&#8217;b": "a\u2019b", "&#x1F600;&#X41;": "\U0001f600A", "&#39;&amp;#39;": "'&#39;", "&#0; &#xD800; &#1114112; &#12 &#;": "&#0; &#xD800; &#1114112; &#12 &#;", "&# &#65": "&# &#65"}
    rows = spark.createDataFrame([(t,) for t in texts], "html string").select("html", warc.plain_text(F.col("html")).alias("text")).collect()
    assert {r.html: r.text for r in rows} == texts


def test_warc_files_round_trip(spark, tmp_path, monkeypatch):
    import glob
    import gzip

    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x \u00e9 \x00</p>\r\n\r\nWARC/1.1 in the text"), (2, None, None), (3, "u", "long " * 900)], "page_id long, url string, html string")
    made = warc.responses(pages)
    for k, most in enumerate((warc.MEMBER_BYTES, 1000)):
        monkeypatch.setattr(warc, "MEMBER_BYTES", most)
        warc.write_warc(warc.response_records(made).coalesce(1), str(tmp_path / f"r{k}"))
        raw = open(glob.glob(f"{tmp_path}/r{k}/part*")[0], "rb").read()
        assert raw.count(b"\x1f\x8b\x08") >= 3 and gzip.decompress(raw).count(b"WARC-Type: response\r\n") == 3
        plain = tmp_path / f"p{k}"
        plain.mkdir()
        (plain / "x.warc").write_bytes(gzip.decompress(raw) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut short")
        want = sorted(map(str, made.select(*warc._FIELDS).collect()))
        assert sorted(map(str, warc.read_responses(spark, str(plain)).select(*warc._FIELDS).collect())) == want
        back = warc.read_responses(spark, str(tmp_path / f"r{k}"))
        assert sorted(map(str, back.select(*warc._FIELDS).collect())) == want
        assert back.columns == made.columns and warc.derivatives(back).count() == 6
    warc.write_warc(warc.derivatives(made).coalesce(1), str(tmp_path / "d"))
    text = gzip.decompress(open(glob.glob(f"{tmp_path}/d/part*")[0], "rb").read()).decode()
    assert text.count("WARC/1.1\r\n") == 6 and text.endswith("\r\n\r\n")


def test_broken_warc_files(spark, tmp_path):
    """A length that is no number and a broken member cost their own record only."""
    import gzip

    record = lambda k, length=None: (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {k}\r\nContent-Length: {length or 9}\r\n\r\nA\r\n\r\nbody\r\n\r\n").encode()
    broken = bytearray(gzip.compress(record("c") * 50))
    broken[12:20] = b"\xff" * 8
    (tmp_path / "a.warc").write_bytes(record("a") + record("x", "many") + record("y", "-5") + record("b"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("d")) + bytes(broken) + gzip.compress(record("e")))
    got = sorted((r.response_id, r.payload) for r in warc.read_responses(spark, str(tmp_path)).collect())
    assert got == [(k, "body") for k in "abde"]


def brute_chat(rows):
    out = {}
    spelled = lambda t: t.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b").replace("|", "\\p")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", spelled(r[3] or ""))
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        lost = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


def read_back(windows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(windows).collect()}


HARD = [
    (1, 0, "system", "be [brief] \\ok <|x|>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\e\\l\\b"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, None, "who"), (1, 5, None, "who"), (1, None, "user", "first"),
    (2, 0, "assistant", "word " * 3000), (2, 1, "user", "hi"), (2, 2, "assistant", "ho"), (3, 2, "system", "late"), (3, 0, "user", "a|b"), (3, 3, "assistant", "x" * 5000), (None, 0, "user|>", "q"), (4, 0, "system", "one"), (4, 1, "system", "two"), (4, 2, "assistant", "three"),
]


@pytest.mark.parametrize("budget", [4096, 900, 600])
def test_chat_round_trip(spark, small, budget, monkeypatch):
    hard = spark.createDataFrame([(*r, 1, "clash") for r in HARD], "conv_id long, turn long, role string, text string, block long, head string")
    assert read_back(chat_format.chat_windows(hard, budget, budget // 8)) == brute_chat(HARD)
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    monkeypatch.setattr(chat_format, "BLOCK", 3)
    monkeypatch.setattr(chat_format, "CROWDED", 2 if budget == 600 else 4096)
    windows = chat_format.chat_windows(table, budget, budget // 8)
    assert read_back(windows) == brute_chat(rows)
    assert all(w.n_tokens <= budget and len(w.text.encode()) == w.n_tokens for w in windows.collect())
    chars = {r.conv_id: r.formatted_chars for r in chat_format.digest(windows).collect()}
    assert chars == {r[0]: r[1] for r in windows.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()}


@pytest.mark.parametrize("block", [1024, 40])
def test_chat_windows_keep_the_budget(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 7)) for k in range(1, 3000)] + [(1, 3000, "assistant", "é\\<" * 3000), (1, 3001, "user", "\\" * 9000), (1, 3002, "assistant", "last")]
    made = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1200, 200)
    windows = sorted(made.collect(), key=lambda w: w.window_id)
    assert len(windows) > 100 and all(len(w.text.encode()) == w.n_tokens <= 1200 for w in windows)
    whole = [w for w in windows if "<+>" not in w.text and "turn" in w.text]
    assert sum(w.n_tokens for w in whole) / len(whole) > (0.9 if block == 1024 else 0.75) * 1200
    assert all(w.text.startswith("<|system|>be kind</s>") for w in windows)
    assert all(w.new_from > len("<|system|>be kind</s>") for w in whole[1:])  # some history in every later window, also in a block's first
    for before, after in zip(whole, whole[1:]):
        repeated = after.text[len("<|system|>be kind</s>") : after.new_from]
        assert before.text.endswith(repeated)
    assert read_back(made) == brute_chat(rows)


def test_chat_sizes_by_tokens(spark):
    rows = [(1, k, "user", "some words here", 3) for k in range(100)]
    windows = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long"), 120, 20, tokens="n").collect()
    assert all(w.n_tokens <= 120 for w in windows) and sum(w.text.count("</s>") for w in windows) > 100
    assert max(w.text.count("</s>") for w in windows) == 8  # 12 bytes of marks and 3 tokens each


def test_crowded_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 4)
    monkeypatch.setattr(chat_format, "CROWDED", 10)
    rows = [(1, k % 3, "assistant", f"text {k} " * 5) for k in range(300)] + [(1, 1, "assistant", "same")] * 20 + [(2, 0, "user", "other")]
    made = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 400, 60)
    got = {r.conv_id: r for r in chat_format.digest(made).collect()}
    assert got[1].n_turns == 320 and got[1].loss_chars == sum(len(r[3]) for r in rows[:-1])
    said = [t for w in sorted(made.filter("conv_id = 1").collect(), key=lambda w: w.window_id) for t in w.text[w.new_from :].split("</s>") if t]
    order = [int(t.split()[1]) % 3 if "text" in t else 1 for t in said]
    assert order == sorted(order) and len(set(said)) == 301
    assert made.select("window_id.block", "window_id.sub").distinct().count() > 20


@pytest.mark.parametrize("stretch", [1, 3, 1024])
def test_chat_stretches_of_long_turns(spark, monkeypatch, stretch):
    """Long turns between, at the start and at the end of blocks; what stretches of any length give reads back whole, and windows keep the budget."""
    monkeypatch.setattr(chat_format, "STRETCH", stretch)
    monkeypatch.setattr(chat_format, "BLOCK", 4)
    sizes = [3, 9000, 5, 60, 7, 2, 4000, 4000, 5000, 1, 2, 3, 40, 50, 30, 7000]
    rows = [(1, t, "assistant" if t % 2 else "user", "é<" * (n // 2) + str(t)) for t, n in enumerate(sizes)] + [(2, 0, "system", "be brief"), (2, 1, "user", "x" * 20_000), (2, 9, "assistant", "short"), (3, 0, None, None)]
    made = chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1200, 200)
    assert read_back(made) == brute_chat(rows)
    windows = made.collect()
    assert max(len(r.text.encode()) for r in windows) <= 1200
    stretches = {r.window_id.stretch for r in windows}
    assert stretches == {0} if stretch == 1024 else len(stretches) > 2
    monkeypatch.undo()
    assert read_back(chat_format.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1200, 200)) == brute_chat(rows)


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.chat_windows(empty).count() == 0


def test_native_plan(spark, small):
    plan = chat_format.op9_chat_format(spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
