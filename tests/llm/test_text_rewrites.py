"""Pseudonyms, chunk fingerprints and main text of pages."""

import hashlib
import html
import random
import re

import numpy as np
import pytest

from tabscope.llm import fingerprints as fp
from tabscope.llm import pii
from tabscope.llm.html_extract import classes, extract, main_text, profiles, read, rounds
from tabscope.llm.pii import FIND, Permutation, Pseudonyms, luhn, pseudonymise
from tabscope.llm.queries import op3_pii_pseudonyms, op6_fingerprints, op10_html_extraction

SF = "/root/testdata/sf0.001"

VALUES = {
    "email": ["bosbt.42@mail8.example.com", "a@b.org"], "card": ["4041894974608795", "4111 1111 1111 1111", "3782-822463-10005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"], "ssn": ["123-45-6789"], "ipv4": ["42.144.35.254", "10.1.2.3", "192.168.0.7"],
    "phone": ["+1 (988) 555-2485", "+1 (017) 555-7713", "212-555-0199", "+44 20 7946 0958"], "date": ["2021-03-14", "14/03/2021", "3/4/1999", "1.12.2007"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_pseudonyms_keep_format_and_can_be_undone(kind, value):
    there, back = Pseudonyms(b"key"), Pseudonyms(b"key", back=True)
    new = getattr(there, kind)(value)
    assert new and new != value and getattr(back, kind)(new) == value
    if kind != "ipv4":
        shape = lambda v: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v)))
        assert shape(new.split("@")[0]) == shape(value.split("@")[0]) or kind == "date"
    found = FIND.fullmatch(new)
    assert found and found.lastgroup == kind
    assert getattr(Pseudonyms(b"other"), kind)(value) != new
    if kind == "card":
        assert luhn(re.sub(r"\D", "", new))


def test_what_fails_its_check_stays():
    own = Pseudonyms(b"key")
    text = "4041894974608796 999.1.1.1 2021-13-40 000-12-3456 id4041894974608795x 1.2.3.4.5 DE00370400440532013000 v1.2.3 +12 2/30"
    assert own.replace(text)[0] == text


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("GB29NWBK60161331926819 BIC NWBKGB2L", ["iban"]), ("GB29 NWBK 6016 1331 9268 19 4111 1111 1111 1111", ["iban", "card"]),
        ("DE89370400440532013000 1234567890 X", ["iban"]), ("XX12 ABCD DE89370400440532013000", ["iban"]), ("1234 4111 1111 1111 1111", ["card"]),
        ("GR1601101250000000012300695 and", ["iban"]), ("TR330006100519786457841326 TL", ["iban"]), ("MT84MALT011000012345MTLCAST001S EUR 20", ["iban"]),
        ("SA0380000000608010167519 12", ["iban"]), ("HU42117730161111101800000000, RO49AAAA1B31007593840000", ["iban", "iban"]),
        ("at 2021-03-14T10:00:00Z and", ["date"]), ("2021-03-14T10:00", ["date"]), ("2021-03-14Tx", []), ("DE89370400440532013000X 1", []),
    ],
)
def test_values_before_other_values_are_replaced(text, kinds):
    new, counts = Pseudonyms(b"key").replace(text)
    assert sorted(counts.elements()) == sorted(kinds)
    values = ("GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "4111 1111 1111 1111", "DE89370400440532013000", "2021-03-14")
    assert len(new) == len(text) and (not kinds or not any(v in new for v in values))
    assert Pseudonyms(b"key", back=True).replace(new)[0] == text


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_without_fixed_values(size):
    p = Permutation(b"key", "t", size)
    out = [p.other(x) for x in range(size)]
    assert sorted(out) == list(range(size)) and [p.other(y, back=True) for y in out] == list(range(size))
    assert size == 1 or all(x != y for x, y in enumerate(out))


def test_pseudonymise_rows(spark):
    text = "Call +1 (988) 555-2485 or mail x.y1@z.example.com"
    rows = [(1, text, "a", 1), (2, text, "b", 2), (2, text, "b", 2), (3, None, None, None), (4, "", "c", 3), (None, "no data " * 200_000 + "42.1.1.9", "d", 4)]
    out = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, replaced string, counts int"), b"key").collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by_id[3].text is None and by_id[4].text == "" and by_id[1].text == by_id[2].text != text
    assert by_id[1].replaced == {"phone": 1, "email": 1} and "42.1.1.9" not in by_id[None].text and by_id[2].counts == 2
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), b"key").count() == 0


def test_no_value_of_a_document_remains(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own, n = Pseudonyms(b"x"), 0
    for r in op3_pii_pseudonyms(spark, SF).collect():
        for m in FIND.finditer(docs[r.doc_id]):
            if own.known[m.lastgroup, m[0]] is not None:
                assert m[0] not in r.text
                n += 1
        assert sum(r[f"n_{k}"] for k in pii.KINDS) or r.text == docs[r.doc_id]
    assert n > 0


def slow_ends(text: bytes) -> list[int]:
    h, hashes = 0, []
    for b in text:
        h = (2 * h + int(fp.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    ends, start = [], 0
    while start < len(text):
        end = min(len(text), start + fp.GREATEST)
        for i in range(start + fp.LEAST - 1, end):
            if not hashes[i] & int(fp.STRICT if i - start < fp.NORMAL else fp.LOOSE):
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends


def test_chunks_equal_a_byte_by_byte_reading():
    r = random.Random(1)
    raw = [b"", b"a", b"q" * 3000, *[bytes(r.choices(range(32, 127), k=r.choice((31, 32, 33, 500, 5000)))) for _ in range(20)]]
    assert fp.chunk_ends(raw) == [slow_ends(t) for t in raw]


def test_chunks_resist_shifts():
    r = random.Random(2)
    text = bytes(r.choices(b"abcdefgh ", k=6000))
    a, b = fp.chunks([text, b"inserted in front " + text])
    assert fp.likeness(a, b) > 0.95 and fp.likeness(a, a) == 1 and fp.likeness(a[:0], b) == 0 and fp.likeness(a[:0], a[:0]) == 1
    assert fp.as_text(a[:0]) == ""


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_neighbours_equal_a_sorted_list(spark, ranges):
    r = random.Random(3)
    docs = [(i * 3 % 101, "".join(r.choices("abcdé 日", k=r.choice((0, 1, 7, 200, 900))))) for i in range(100)] + [(7, None), (None, "without id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(d, t, 1, False) for d, t in docs], "doc_id long, text string, place int, copy boolean").repartition(4)
    rows = fp.neighbour_fingerprints(df, ranges=ranges).collect()
    assert len(rows) == len(docs)
    by_id = {}
    for x in rows:
        by_id.setdefault(x.doc_id, []).append(x)
    unique = sorted({d: t for d, t in docs if d is not None and d not in (5, 7)}.items(), reverse=True)
    for (d, t), (e, u) in zip(unique, unique[1:]):
        if d - 1 in (5, 7) or e < d - 1:
            continue
        changed = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        (x,) = by_id[d]
        a, b, c = fp.chunks([t.encode(), changed.encode(), u.encode()])
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.as_text(a), fp.as_text(b))
        assert np.allclose((x.near_edited, x.near_next), (fp.likeness(a, b), fp.likeness(a, c)))
    last = by_id[None][0]
    first = unique[0][1]
    assert last.edited_sha256 == hashlib.sha256(("without id"[:5] + first[:5]).encode()).hexdigest()


def test_neighbours_of_one_and_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fp.neighbour_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.neighbour_fingerprints(one.limit(0)).count() == 0


def test_fingerprints_whole(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in op6_fingerprints(spark, SF).collect()}
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        assert rows[d].edited_sha256 == hashlib.sha256(fp.edited(t, u).encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">Cookies!</div><div id=sidebar><p>Side</div>
<article class="post"><h1>Title &amp; more</h1><p>One <b>bold</b>&nbsp; text<br>second
 line<p>Third &lt;tag&gt; <!-- hidden --> x<form><input>Name</form><ul><li>item<li>other</ul><div class="ad">Buy</div>
<section class="comments"><p>Nice post!</p></section></article><aside>Related</aside><footer>&copy; Me</footer></body></html>"""


def test_extract_by_roles():
    assert extract(PAGE, frozenset()).split("\n") == ["Title & more", "One bold text", "second line", "Third <tag> x", "item", "other"]
    assert extract("", frozenset()) == "" and extract("just text", frozenset()) == "just text"
    assert extract("<p>a<p>b</i> c <sc", frozenset()) == "a\nb c"


def _pages(spark, rows):
    df = spark.createDataFrame([(*x, "h", ["t"]) for x in rows], "page_id long, url string, html string, host string, template array<string>").repartition(4)
    return {x.page_id: x for x in main_text(df).collect()}


def _words(r, k=60):
    return " ".join(r.choices([f"w{i}" for i in range(500)], k=k))


def test_template_blocks_are_left_out_and_running_text_stays(spark):
    r = random.Random(4)
    texts = [f"Written by staff: {_words(r)}" for _ in range(30)]
    page = "<html><body><div><span>Share this page</span></div><div><p>{}</p></div></body></html>"
    rows = [(i, f"http://host.example/{i}", page.format(t)) for i, t in enumerate(texts)] + [(100, "http://few.example/", page.format("alone")), (101, None, None), (101, None, None), (102, "x", "")]
    found = _pages(spark, rows)
    assert [found[i].text for i in range(30)] == texts
    assert found[100].text == "Share this page\nalone" and found[101].text == "" and found[102].n_chars == 0
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert main_text(df).count() == len(rows) and main_text(df.limit(0)).count() == 0


def test_empty_pages_and_copies_do_not_make_or_end_a_template(spark):
    r = random.Random(5)
    texts = [_words(r) for _ in range(25)]
    page = "<html><body><div><h4>Written by staff</h4><p>{}</p></div></body></html>"
    rows = [(i, "http://host.example/", page.format(t)) for i, t in enumerate(texts)]
    rows += [(100, "http://host.example/", None), (101, "http://host.example/", ""), (102, "http://host.example/", " <!-- x -->")]
    rows += [(200 + i, "http://copies.example/", page.format("one text of its own")) for i in range(30)]
    found = {i: x.text for i, x in _pages(spark, rows).items()}
    assert [found[i] for i in range(25)] == texts and [found[i] for i in (100, 101, 102)] == [""] * 3
    assert {found[200 + i] for i in range(30)} == {"Written by staff\none text of its own"}


PLAIN = """<html><body><div><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div><h2>{0}</h2>{1}</div>{2}
<div><ul><li>News<li>Terms of use of Site</ul></div></body></html>"""
EXTRA = "<div class=box-{0}><h3>Our shop</h3><p>Mugs and more</p></div>"


@pytest.mark.parametrize("n", [5, 30])
def test_plain_hosts_lose_menus_optional_parts_and_foots(spark, n):
    """No element names a role: repeated menu items, a part that a third of the pages have, an error
    page and a cut page. A passage of two fifths of the pages and short blocks are article text."""
    r = random.Random(6)
    rows, want = [], {}
    for i in range(n):
        blocks = [f"Today we saw {i} birds near lake{i}.", _words(r, 20), *(["A passage that some pages of this host share."] if i % 5 < 2 else []), _words(r, 5)]
        more = EXTRA.format(i) if n > 5 and i % 3 == 0 else ""
        rows.append((i, "http://plain.example/a", PLAIN.format(f"Title {i}", "".join(f"<p>{b}</p>" for b in blocks), more)))
        want[i] = "\n".join([f"Title {i}", *blocks])
    rows.append((100, "http://plain.example/x", "<html><body>Server error"))
    rows.append((101, "http://plain.example/y", PLAIN.format("Cut page", "<p>It ends he", "")[:130]))
    found = _pages(spark, rows)
    assert {i: found[i].text for i in want} == want
    assert found[100].text == "Server error" and found[101].text.startswith("Cut page")
    assert "Home" not in found[101].text


def test_classes_equal_brute_force_vectors(spark):
    """Vectors of each token over the different pages of a host, written out in full."""
    r = random.Random(7)
    html_of = lambda: "<body>" + "".join(f"<div><p>{r.choice('abcde')}</p></div>" for _ in range(r.randint(0, 4))) + "<ul><li>x<li>y</ul>"
    rows = [("h%d" % r.randint(0, 2), html_of()) for _ in range(60)]
    df = spark.createDataFrame(rows, "host string, html string").repartition(5)
    got = {}
    for x in classes(profiles(df), 3, 0.25).collect():
        got.setdefault(x.host, set()).add((frozenset(x.tokens), x.most))
    want = {}
    for host in {h for h, _ in rows}:
        pages = sorted({tuple(read(p)[0]) for h, p in rows if h == host})
        vectors = {}
        for t in {t for p in pages for t in p}:
            vectors.setdefault(tuple(p.count(t) for p in pages), set()).add(t)
        for v, ts in vectors.items():
            on = sum(map(bool, v))
            large = len(ts) >= 3 and sum(t % 2 == 0 for t in ts) >= 2
            if on >= max(3, len(pages) / 4) and (2 * on > len(pages) or large):
                want.setdefault(host, set()).add((frozenset(ts), 2 * on > len(pages)))
    assert got == want and want


def test_rounds_of_classes():
    member, sizes = {2: 1, 4: 1, 6: 2, 8: 2, 9: 3}, {1: 2, 2: 2, 3: 1}
    ordered = lambda page: {c: bool(k) for c, k in rounds(page, member, sizes).items()}
    assert ordered([2, 6, 9, 8, 7, 4, 2, 4]) == {1: True, 2: True, 3: True}
    assert ordered([2, 4, 4, 2]) == {1: False}
    assert ordered([2, 6, 4, 8]) == {1: True, 2: False}
    assert rounds([2, 4], member, sizes)[1] != rounds([4, 2], member, sizes)[1]


def test_deep_and_long_pages_are_read_whole(spark):
    deep = "<div>" * 20_000 + "x" + "</p>" * 20_000
    long = "<p>" + "word &amp; " * 300_000 + "</p><p>end"
    found = _pages(spark, [(1, "http://a.example", deep), (2, "http://a.example", long)])
    assert found[1].text == "x" and found[2].text == "word & " * 299_999 + "word &\nend"


def test_pages_whole(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op10_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)
