"""Main text of web pages, by templates deduced from pages of the same host.

A page is a sequence of tokens: the tags of block elements, each with its path of open elements
(names, roles and class names), and the texts of whole blocks with the path they stand in. For
every host:

* tokens with one occurrence vector (how often they come in each different page) form a class;
* a class counts if it is on three pages and a quarter of the host's different pages, and is on
  more than half of them or has three tokens of which two are tags (an optional part of the page);
* it is valid if it is ordered (its tokens come round in one order) and nested (between its first and
  last token no other class begins and stays open) in four fifths of its pages. A class that fails is divided
  into its tokens, which must then each be on more than half of the pages;
* the valid classes, nested in each other, are the template. What lies between template tokens is a
  slot; slots are kept whole, so words of running text are never fixed text.

From a page, the slots are taken that stand in no element of another role (menus, heads, foots,
sidebars, forms, adverts, notices, comments): those of its ``article`` elements if it has such text,
else those of ``main``, else all. Roles only choose between slots, but inside ``article`` a block stays even if
it is part of the template: near copies of one article would otherwise delete it. A host with fewer than three
different pages has no classes, so all of its blocks are slots. Shares are used, not unanimity: an
error page or a cut page does not end the template of its host.

Null or empty pages give empty text and are in no vector. Urls that are null or have no host are pages of one host
named by the empty string. Cut tags and unclosed elements end where the page ends. Repeated
pages are one page in the vectors; an empty table gives an empty table; very long pages are read
whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lists, scrambled, steps, stored, texts

#: Different pages a class must be on.
MIN_PAGES = 3
#: Share of a host's different pages a class must be on.
SHARE = 0.25
#: Share of a class's pages that must show it ordered and nested.
VALID = 0.8
#: Tokens of an optional class, and how many of them must be tags.
MIN_SIZE, MIN_TAGS = 3, 2

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul video audio canvas".split()
)
NO_ARTICLE = frozenset("nav footer aside form head header menu dialog button fieldset".split())
ROLES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav(?:bar|igation)?|menu|breadcrumbs?|footer|header|"
    r"masthead|side-?bar|aside|widget|related|share|social|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|"
    r"comments?|comment-?list|replies|disqus|login|signup|search)(?:$|[\s_-]|\d)",
    re.I,
)
#: An element of these names closes an open one of the same name.
SELF_CLOSING = {"p": BLOCKS - {"br", "hr"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) for start and end tags and runs of text, raw elements left out."""
    at = 0
    lowered = None
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            yield "end", name, ""
            continue
        yield "start", name, found[3]
        if name in RAW and not found[3].rstrip().endswith("/"):
            lowered = page.lower() if lowered is None else lowered
            close = lowered.find(f"</{name}", at) if len(lowered) == len(page) else _find(page, name, at)
            at = len(page) if close < 0 else close


def _find(page: str, name: str, at: int) -> int:
    found = re.compile(f"</{name}", re.I).search(page, at)
    return found.start() if found else -1


def outside(name: str, attributes: str) -> bool:
    """Whether an element's role is other than article text."""
    if name in NO_ARTICLE or name in RAW:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id", "role") and ROLES.search(value):
            return True
    return False


_text = Memo(lambda t: xxhash.xxh3_64_intdigest(t) >> 1 | 1)
_role = Memo(lambda x: outside(*x))


def shape(attributes: str) -> str:
    """Class names of an element, numbers as one digit."""
    return " ".join(re.sub(r"\d+", "0", v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes) if k.lower() == "class")


def _opened(key: tuple[int, str, str, bool]) -> int:
    path, name, attributes, role = key
    own = shape(attributes) if attributes and name not in ("html", "body") else ""
    return xxhash.xxh3_64_intdigest(f"{path} {name} {role} {own}") >> 1


_path = Memo(_opened)


def read(page: str) -> tuple[list[int], list[tuple[int, str, bool, int]]]:
    """Tokens in page order (texts are odd, tags even), and per block of text: token, text,
    whether it is in an element of another role, and 1 in ``main``, 2 in ``article``, else 0."""
    tokens: list[int] = []
    lines: list[tuple[int, str, bool, int]] = []
    run: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []
    names: Counter[str] = Counter()  # open elements, so that a stray end tag costs nothing
    path, away, inside = 0, False, 0
    at, where = 0, (False, 0)

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            token = (at ^ _text[text]) | 1
            tokens.append(token)
            lines.append((token, text, *where))

    for kind, what, attributes in events(page):
        if kind == "text":
            if run and (away, inside) != where:
                close()
            if not run:
                at, where = path, (away, inside)
            run.append(what)
            continue
        block = what in BLOCKS
        if block:
            close()
        if kind == "end":
            if names[what]:
                while True:
                    name, path, away, inside = stack.pop()
                    names[name] -= 1
                    if name == what:
                        break
            if block:
                tokens.append((path ^ _text["</" + what]) & ~1)
            continue
        while stack and what in SELF_CLOSING.get(stack[-1][0], ()):
            name, path, away, inside = stack.pop()
            names[name] -= 1
        role = _role[what, attributes] if attributes or what in NO_ARTICLE or what in RAW else False
        own = _path[path, what, attributes, role] if block else path
        if block:
            tokens.append(own & ~1)
        if what in VOID:
            continue
        stack.append((what, path, away, inside))
        names[what] += 1
        path, away = own, away or role
        inside = 2 if what == "article" else max(inside, 1) if what == "main" else inside
    close()
    return tokens, lines


def extract(page: str, template: frozenset[int]) -> str:
    """Blocks of the slots that remain, white space in a block as one space, a line each."""
    lines = [x for x in read(page)[1] if not x[2]]
    level = max((x[3] for x in lines), default=0)
    return "\n".join(x[1] for x in lines if x[3] == level and (level == 2 or x[0] not in template))


def profiles(pages: DataFrame) -> DataFrame:
    """(host, content, tokens): the tokens of every different page of a host that has any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "html"):
            found = [np.array(read(p)[0], np.int64) for p in texts(step, "html")]
            some = [i for i, x in enumerate(found) if len(x)]
            if not some:
                continue
            content = [xxhash.xxh3_64_intdigest(found[i].tobytes()) >> 1 for i in some]
            parts = [step.column(0).take(pa.array(some)), pa.array(content, pa.int64())]
            flat = lists(np.concatenate([found[i] for i in some]), np.array([len(found[i]) for i in some]), pa.int64())
            yield pa.RecordBatch.from_arrays([*parts, flat], ["host", "content", "tokens"])

    rows = pages.select("host", "html").mapInArrow(scan, "host string, content long, tokens array<long>")
    return rows.dropDuplicates(["host", "content"])


def occurrences(own: DataFrame) -> DataFrame:
    """(host, token, vector, n): hash of a token's occurrence vector, and its number of pages.

    The hash is the exclusive or of a mix of page and count over the pages that hold the token, so it is
    added up in any order. Tasks add up their own pages first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts = batch.column(0).dictionary_encode()
            tokens = batch.column(2).flatten().to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            page = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.lexsort((tokens, page))
            tokens, page = tokens[order], page[order]
            starts = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (page[1:] != page[:-1])]))
            counts = np.diff(np.append(starts, len(tokens))).astype(np.uint64)
            tokens, page = tokens[starts], page[starts]
            content = batch.column(1).to_numpy().astype(np.uint64)
            mixed = scrambled(content[page] + scrambled(counts))
            host = hosts.indices.to_numpy()[page]
            order = np.lexsort((tokens, host))
            tokens, host, mixed = tokens[order], host[order], mixed[order]
            starts = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (host[1:] != host[:-1])]))
            vector = np.bitwise_xor.reduceat(mixed, starts).view(np.int64)
            n = np.diff(np.append(starts, len(tokens)))
            names = hosts.dictionary.take(pa.array(host[starts]))
            yield pa.RecordBatch.from_arrays([names, pa.array(tokens[starts]), pa.array(vector), pa.array(n, pa.int64())], ["host", "token", "vector", "n"])

    rows = own.select("host", "content", "tokens").mapInArrow(add, "host string, token long, vector long, n long")
    return rows.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("n").alias("n"))


def classes(own: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(host, vector, tokens, most): classes large and frequent enough; ``most`` if on more than half of the pages.

    A host has at most 1 / ``share`` times as many tokens here as a page of it has on average."""
    totals = own.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    frequent = occurrences(own).where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") >= share * F.col("pages"))
    alike = frequent.groupBy("host", "vector").agg(
        F.collect_list("token").alias("tokens"), (F.max("n") * 2 > F.max("pages")).alias("most"),
        F.count("*").alias("size"), F.sum(1 - F.col("token") % 2).alias("tags"),
    )
    return alike.where(F.col("most") | (F.col("size") >= MIN_SIZE) & (F.col("tags") >= MIN_TAGS)).select("host", "vector", "tokens", "most")


def rounds(tokens: list[int], member: dict[int, int], sizes: dict[int, int]) -> dict[int, int]:
    """Per class in a page: hash of the order of its tokens, or 0 if they do not come round in one
    order or another class begins between them and does not end there."""
    seen: dict[int, list[int]] = {}
    crossed: set[int] = set()
    open_: list[int] = []
    for t in tokens:
        c = member.get(t)
        if c is None:
            continue
        own = seen.setdefault(c, [])
        if len(own) % sizes[c]:
            while open_ and open_[-1] != c:
                crossed.add(open_.pop())
        elif sizes[c] > 1:
            open_.append(c)
        own.append(t)
        if sizes[c] > 1 and not len(own) % sizes[c] and open_ and open_[-1] == c:
            open_.pop()
    out = {}
    for c, own in seen.items():
        first = own[: sizes[c]]
        ordered = len(set(first)) == sizes[c] and own == first * (len(own) // sizes[c])
        out[c] = (xxhash.xxh3_64_intdigest(np.array(first, np.int64).tobytes()) >> 1 | 1) if ordered and c not in crossed else 0
    return out


def templates(own: DataFrame, found: DataFrame) -> DataFrame:
    """(host, template): the texts of the classes that are ordered and nested in enough of their pages."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple[dict, dict]] = {}
            shown: Counter = Counter()
            for i, host in enumerate(batch.column(0).to_pylist()):
                if host not in known:
                    own_classes = batch.column(2)[i].as_py()
                    known[host] = (
                        {t: c["vector"] for c in own_classes for t in c["tokens"]}, {c["vector"]: len(c["tokens"]) for c in own_classes},
                    )
                for c, key in rounds(batch.column(1)[i].as_py(), *known[host]).items():
                    shown[host, c, key] += 1
            if shown:
                rows = [(*k, n) for k, n in shown.items()]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["host", "vector", "key", "n"])

    per_host = found.groupBy("host").agg(F.collect_list(F.struct("vector", "tokens")).alias("classes"))
    joined = own.join(per_host, "host").select("host", "tokens", "classes")
    shown = joined.mapInArrow(order, "host string, vector long, key long, n long").groupBy("host", "vector", "key").agg(F.sum("n").alias("n"))
    best = shown.groupBy("host", "vector").agg(F.sum("n").alias("all"), F.max(F.when(F.col("key") != 0, F.col("n"))).alias("best"))
    valid = best.select("host", "vector", (F.coalesce("best", F.lit(0)) >= VALID * F.col("all")).alias("valid"))
    kept = found.join(valid, ["host", "vector"]).where(F.col("valid") | F.col("most"))
    return kept.select("host", F.explode(F.filter("tokens", lambda t: t % 2 == 1)).alias("token")).groupBy("host").agg(F.collect_set("token").alias("template"))


def main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE
) -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars``. Pages are parsed twice: for the vectors and for the text."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    kind = pages.schema["id"].dataType.simpleString()
    own = stored(profiles(pages))
    found = stored(templates(own, stored(classes(own, min_pages, share))))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "html"):
            sets: dict[str, frozenset] = {}
            for i, host in enumerate(step.column(3).to_pylist()):
                if host not in sets:
                    sets[host] = frozenset(step.column(4)[i].as_py() or ())
            out = [extract(p, sets[h]) for p, h in zip(texts(step, "html"), step.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    joined = pages.join(found, "host", "left").select("id", "url", "html", "host", "template")
    return joined.mapInArrow(take, f"id {kind}, url string, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars")
    )
