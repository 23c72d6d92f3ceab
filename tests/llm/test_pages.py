"""Main text by hand-written pages and the article markup; archives by exact round trips."""

import base64
import collections
import hashlib
import html
import io
import pathlib
import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, main_text, queries, warc


def article_text(page):
    a = page[page.index("<article>") + 9 : page.index("</article>")]
    a = re.sub(r"</?b>", "", a).replace("<br>", " ")
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", a)) if t)


def test_pages_give_their_articles(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_host_suffix_array(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_places():
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id='menu'><ul><li>a<li>b</ul></div><div class=\"content\"><article class=post><header><h1>Title &amp; x</h1></header>"
        "<p>One <b>two</b>&nbsp;three<!-- no --><p>Four<aside>no</aside><div class='share'>no</div><script>var a='</p>';</script><table><tr><td>c1<td>c2</table><section class=comments><article><p>reader</p></article></section><p>five</article>"
        "</div><form>q</form><div class=\"ad\">buy</div><footer>f</footer></body></html>"
    )
    assert main_text.main_texts([page]) == ["Title & x\nOne two three\nFour\nc1\nc2\nfive"]
    assert main_text.main_texts(["", "<p>", "plain  text", "<script>x", "<!-- never closed", "a &lt;b&gt; &#233; &am"]) == ["", "", "plain text", "", "", "a <b> é &am"]


def test_broken_and_odd_markup():
    got = main_text.main_texts([
        "<body class='home with-sidebar'><article><p title=don't>kept</p></article></body>",
        "<div class=ad>never closed<article><p>still here</p></article>",
        "<article><p>main</p></article><section class='comments'><article><p>a reader</p></article></section>",
        "<main><p>in main</p><div role='navigation'>menu</div></main><p>outside, unique</p>",
        "<a " + 'b="c" ' * 3000,
        "<article><p>a < b and c > d</p><p>x" + "<b>" * 2000 + "y</article>",
    ])
    assert got[:4] == ["kept", "still here", "main", "in main\noutside, unique"] and got[5] == "a < b and c > d\nxy"


def shared_by_brute_force(pages, width):
    """Runs of that many tokens inside a block that stand on two distinct pages."""
    where = {}
    for i, page in enumerate(pages):
        for block in page:
            for k in range(len(block) - width + 1):
                where.setdefault(tuple(block[k : k + width]), set()).add(i)
    return {r for r, on in where.items() if len(on) > 1}


def test_suffix_array_against_substrings():
    r = random.Random(8)
    pool = [[f"r{j}t{k}" for k in range(r.randint(1, 60))] for j in range(25)]
    pages = []
    for i in range(60):
        page = []
        for b in range(r.randint(1, 5)):
            own = [f"p{i}b{b}w{k}" for k in range(r.randint(0, 40))]
            run = r.choice(pool)
            lo = r.randint(0, len(run) - 1)
            page.append(own + run[lo : lo + r.randint(1, 60)] + own[:5] or ["x"])
        pages.append(page)
    size, sure = main_text.MIN_RUN, main_text.MIN_RUN + main_text.SPARSE - 1
    runs, long_runs = shared_by_brute_force(pages, size), shared_by_brute_force(pages, sure)
    whole = collections.Counter(b for page in pages for b in {tuple(x) for x in page})
    suffixes, where = main_text.Suffixes(), collections.defaultdict(set)
    named = [suffixes.of("h", [" ".join(b) for b in page]) for page in pages]
    for i, (name, *_) in enumerate(named):
        for x in name.tolist():
            where[x].add(i)
    found = 0
    for page, (name, block, place, sizes) in zip(pages, named, strict=True):
        hit = np.array([len(where[x]) > 1 for x in name.tolist()])
        for h, b, at in zip(hit, block, place, strict=True):
            assert h == (whole[tuple(page[b])] > 1) if at < 0 else not h or tuple(page[b][at : at + size]) in runs
        cover = main_text.covered(hit, block, place, sizes)
        for b, words in enumerate(page):
            if whole[tuple(words)] > 1:
                assert cover[b] == len(words)
                continue
            by_runs, sure_of = set(), set()
            for k in range(len(words)):
                by_runs |= set(range(k, k + size)) if tuple(words[k : k + size]) in runs else set()
                sure_of |= set(range(k + main_text.SPARSE - 1, k + size)) if tuple(words[k : k + sure]) in long_runs else set()
                if tuple(words[k : k + sure]) in long_runs:
                    assert any(h and x == b and k <= at <= k + main_text.SPARSE - 1 for h, x, at in zip(hit, block, place, strict=True)), "a long run has a kept suffix"
                    found += 1
            assert cover[b] <= len(by_runs) and (not sure_of or cover[b] >= size)
    assert found > 100


def test_few_tokens():
    for n in range(12):
        for pages in (1, 2, 3):
            text = " ".join(f"w{j}" for j in range(n))
            assert main_text.main_texts([f"<p>{text}</p>"] * pages) == [text] * pages, "equal pages are one page"


def test_runs_decide_where_markup_does_not():
    notice = "<div>We use many small things on this site to count all its readers</div>"
    own = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(12)]
    pages = [f"<body>{notice}<p>{t}</p></body>" for t in own]
    assert main_text.main_texts(pages) == own
    assert all("count" in t for t in main_text.main_texts(pages[:1])), "one page is no evidence"
    inside = [p.replace("<body>", "<article>").replace("</body>", "</article>") for p in pages]
    assert all("count" in t for t in main_text.main_texts(inside)), "articles share passages"
    beside = [f"<body>{notice}<article><p>{t}</p></article><div>{t[::-1]}</div><p>short</p></body>" for t in own]
    assert main_text.main_texts(beside) == [f"{t}\n{t[::-1]}" for t in own], "unique runs beside an article stay"
    near = [f"<p>{' '.join(own[0].split()[:19])} {i}</p><p>{own[1]}</p>" for i in range(2)]
    assert main_text.main_texts(near) == [re.sub("</p><p>", "\n", p)[3:-4] for p in near], "copies are no boilerplate of each other"


def test_unique_text_stays_and_repeated_text_goes(monkeypatch):
    own = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(20)]
    menu = "<ul><li>Home and news of all kinds<li>Sports<li>Weather and the traffic in town today, hour by hour</ul>"
    titled = [f"<body><h1>Storm {i}</h1><p>By A. Writer {i}</p><div>Follow us</div><article><p>{t} <math><mi>x{i}</mi><mo>=</mo></math></p></article></body>" for i, t in enumerate(own)]
    want = [f"Storm {i}\nBy A. Writer {i}\n{t} x{i}=" for i, t in enumerate(own)]
    assert main_text.main_texts(titled) == want, "titles outside of the article stay, what every page says goes"
    for head in ("<main>", '<div class="content-wrapper">', '<div id="main-container">', '<div class="wrapper">', "<div>"):
        pages = [f"<body>{head}{menu}<h1>Title {i}</h1><p>{t}</p></body>" for i, t in enumerate(own)]
        assert main_text.main_texts(pages) == [f"Title {i}\n{t}" for i, t in enumerate(own)], head
    monkeypatch.setattr(main_text, "covered", lambda hit, block, place, sizes: np.zeros(len(sizes), dtype=np.int64))
    assert main_text.main_texts(titled) != want, "runs decide"


@pytest.mark.parametrize("names", [4_000_000, 0])
def test_every_run_of_eight_tokens_counts(spark, monkeypatch, names):
    monkeypatch.setattr(main_text, "BROADCAST_NAMES", names)
    pages, want = [], []
    for j in range(40):
        run, text = " ".join(f"r{j}t{k}" for k in range(8)), [" ".join(f"p{j}q{i}w{k}" for k in range(20)) for i in range(2)]
        pages += [f"<div>a{j} {run} b{j}</div><article>{text[0]}</article>", f"<article>{text[1]} {run} c{j}</article><div>d{j} {run[:-1]}</div>"]
        want += [text[0], f"{text[1]} {run} c{j}\nd{j} {run[:-1]}"]
    assert main_text.main_texts(pages) == want, "8 of 10 tokens are covered, by an article of another page too; 7 are no run"
    d = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(5)
    assert [r["text"] for r in main_text.extract_main_text(d).orderBy("page_id").collect()] == want


def test_many_half_repeated_blocks():
    shared = " ".join(f"s{k}" for k in range(40))
    pages = ["".join(f"<p>{shared} {' '.join(f'p{i}b{b}t{k}' for k in range(12))}</p>" for b in range(8000)) for i in range(2)]
    suffixes = main_text.Suffixes()
    name, block, place, sizes = suffixes.of("", [t for t, _, _ in main_text.parsed(pages[0])])
    hit = np.arange(len(name)) % 3 > 0
    hit[: len(sizes)] = False
    began = time.perf_counter()
    got = main_text.covered(hit, block, place, sizes)
    assert time.perf_counter() - began < 1 and len(got) == 8000
    for b in (0, 1, 4567, 7999):
        held, mine = set(), [(p, h) for x, p, h in zip(block[8000:], place[8000:], hit[8000:], strict=True) if x == b]
        for k, (p, h) in enumerate(mine):
            if h:
                held |= set(range(p, max(mine[k + 1][0], p + 8) if k + 1 < len(mine) and mine[k + 1][1] else p + 8))
        assert got[b] == len(held)


def test_class_names_break_ties_only():
    own = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(3)]
    pages = [f"<article><p>{t}</p><div class='social-history'>{t[::-1]}</div><div class='share-buttons'>Share this page with all the friends you have</div><div class=share>x {i}</div></article><div class='my-ad'>{t}</div>" for i, t in enumerate(own)]
    assert main_text.main_texts(pages) == [f"{t}\n{t[::-1]}" for t in own]
    assert main_text.main_texts([f"<div class='social-history'>{own[0]}</div><div class='ad-box'>Buy</div>"]) == [own[0]]


@pytest.mark.parametrize("names", [4_000_000, 0])
def test_a_large_host_on_any_number_of_partitions(spark, monkeypatch, names):
    monkeypatch.setattr(main_text, "BROADCAST_NAMES", names)
    notice = "<div>We use many small things on this site to count all its readers</div>"
    rows = [(i, f"http://h.org/{i}", f"{notice if i in (3, 300) else ''}<p>{' '.join(f'p{i}w{j}' for j in range(20 if i else 30_000))}</p>") for i in range(320)]
    rows += [(400 + i, f"http://other{i}.org/", f"{notice}<p>{' '.join(f'q{i}w{j}' for j in range(20))}</p>") for i in range(2)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {i: re.sub(r"<.*?>", "", h.replace("</div><p>", "\n") if i >= 400 else h.replace(notice, "")) for i, _, h in rows}
    for parts in (1, 7, 211):
        assert {r["page_id"]: r["text"] for r in main_text.extract_main_text(d.repartition(parts)).collect()} == want


def test_page_edges(spark):
    rows = [(1, "http://a.b/x", None), (1, None, "<p>t</p>"), (None, "not a url", "<p>u"), (2, "http://a.b/y", ""), (2, "http://a.b/y", "")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in main_text.extract_main_text(d).collect())
    assert got == sorted([("1", "http://a.b/x", "", 0), ("1", "None", "t", 1), ("None", "not a url", "u", 1), ("2", "http://a.b/y", "", 0), ("2", "http://a.b/y", "", 0)])
    assert main_text.extract_main_text(d.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_dictionaries_see_all_records(monkeypatch):
    """The sample is spread over all records and all of a long one."""
    import zstandard

    seen = []
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, some, **_: seen.extend(some) or zstandard.ZstdCompressionDict(b"x" * 64, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    monkeypatch.setattr(warc, "TRAIN_BYTES", 256 << 10)
    records = [bytes([65 + i % 26]) * 4096 for i in range(78)] + [b"".join(bytes([97 + i]) * 16384 for i in range(26))]
    warc.train(records)
    letters = {p[:1] for p in seen}
    assert sum(map(len, seen)) <= 2 * warc.TRAIN_BYTES and len([x for x in letters if x.isupper()]) >= 2 and len([x for x in letters if x.islower()]) >= 2
    assert all(len(p) <= warc.PIECE_BYTES for p in seen)


def test_round_trip_leaves_no_archives(spark, sf):
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.glob("warc-*")}
    queries.op7_warc_dictionary(spark, sf).count()
    assert {p.name for p in folder.glob("warc-*")} == before


def test_archive_format():
    for records in ([b""], [b"x"], [warc.record(i, f"http://a/{i}", b"<p>some page</p>" * i, None) for i in range(300)]):
        raw = warc.archive(records)
        assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
        assert list(warc.read_archive(io.BytesIO(raw))) == records
    fields, payload, n = warc.parse(warc.record(7, "http://a/b c\r\nX: y", "é\r\n\r\n".encode(), None))
    assert payload == "é\r\n\r\n".encode() and n == len(payload) and fields["x-page-id"] == "7" and "\n" not in fields["warc-target-uri"]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        r = f if f is not None and f != i else None
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if r is not None else "response", str(r)))
    return sorted(out)


def seen(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in df.collect())


def test_round_trip(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert seen(queries.op7_warc_dictionary(spark, sf)) == expected(rows)


def test_warc_edges(spark, monkeypatch):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "long " * 50_000), (1, None, "same")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    assert seen(warc.round_trip(d)) == expected(rows)
    some = warc.read_archives(warc.write_archives(d, warc.archive_folder(d)))
    assert {r["page_id"]: bytes(r["payload"]) for r in some.where("record_type = 'response'").collect()}[5] == b"long " * 50_000
    assert warc.round_trip(d.limit(0)).count() == 0
    small = warc.round_trip(d, min_bytes=5)
    assert {r["record_type"] for r in small.collect()} == {"response"}
