"""Main text of web pages by equivalence-class template deduction.

A token is an element's path or a text at its path (a 64-bit hash of both), in the main element as elsewhere.
Its occurrence vector says how often it occurs on each page of a host; the vectors are compared through a
fingerprint (the exclusive or of a hash of page and count) that Spark combines before the shuffle, so a host
with a third of all pages is no heavier than another. Tokens with one vector form an equivalence class, in
the order of their mean place. A class is valid when it covers enough of the host's pages and has enough
tokens; on a page it holds where its tokens stand in its order, as often as the class repeats, and where it
nests: its span lies within a gap of a wider class or beside it, and never crosses one. The classes that
hold are the page's template, and what stands between their tokens are its slots. A page's text is what
stands in the slots of its main elements, or of its body where it has none. Names of elements and classes
only help: they tell slots of menus, adverts and comments from those of the article.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import shared

LEAST_PAGES, LEAST_SHARE, LEAST_CLASS = 4, 0.6, 2

BLOCKS = set("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
ASIDE = set("nav footer aside form script style noscript iframe object svg canvas audio video button select option textarea label input template dialog head title menu".split())
#: Names that mark such an element where a class, id or role is such a word or begins or ends with one.
ASIDE_WORDS = set("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe signup login search footer pagination pager widget masthead topbar complementary contentinfo".split())
#: Names of what readers wrote: an article in it is one of theirs, never the page's.
READER_WORDS = set("comment comments reply replies response responses discussion respond disqus".split())
#: A name with one of these says what stands beside the element, not what it is.
BESIDE = set("with has have without no non not is in under below above before after hide show layout".split())
MAIN_ROLES = {"main", "article"}
_CLOSES_P = BLOCKS - {"body", "html", "title"}


def _marked(names: list[str]) -> int:
    """0: no name says so, 1: a name of something beside the article, 2: a name of what readers wrote."""
    mark = 0
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
        if words and not BESIDE.intersection(words):
            ends = {words[0], words[-1]}
            mark = max(mark, 2 * bool(ends & READER_WORDS), int(bool(ends & ASIDE_WORDS)))
    return mark


class _Page(HTMLParser):
    """The tokens of a page in order: ``(token, main element, aside, text)``, the text being None for an element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int]] = []
        self.open: Counter = Counter()
        self.path, self.aside, self.main = 0, 0, 0
        self.mains, self.text, self.tokens = 0, [], []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.tokens.append((xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), self.path), self.main, bool(self.aside), text))

    def _pop_to(self, tag: str) -> None:
        if not self.open[tag]:
            return
        flush, names = False, []
        while True:
            name, path, aside, main = self.stack.pop()
            self.open[name] -= 1
            names.append(name)
            flush = flush or name in BLOCKS or aside != self.aside
            if name == tag:
                break
        if flush:
            self._flush()
        self.path, self.aside, self.main = path, aside, main

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and self.open["p"]:
            self._pop_to("p")
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self._pop_to(tag)
        named = [n for k, v in attrs if k in ("class", "id", "role") for n in (v or "").split()]
        hidden = any(k == "hidden" for k, _ in attrs) or any(k == "aria-hidden" and v == "true" for k, v in attrs)
        # 2: by the element itself or as the readers' part, 1: by another name, which a main element in it overrules
        own = 2 if tag in ASIDE or hidden or (tag == "header" and not self.main) else 0 if tag in ("html", "body", "main") else _marked(named)
        aside, main = max(self.aside, own), self.main
        if not main and own == 0 and aside < 2 and (tag in ("article", "main") or any(k == "role" and v in MAIN_ROLES for k, v in attrs)):
            self.mains += 1
            main, aside = self.mains, 0
        if tag in BLOCKS or aside != self.aside:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        self.stack.append((tag, self.path, self.aside, self.main))
        self.open[tag] += 1
        self.path, self.aside, self.main = xxh3_64_intdigest(tag.encode(), self.path), aside, main
        self.tokens.append((self.path, main, bool(aside), None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._pop_to(tag)

    def handle_data(self, data):
        self.text.append(data)


def tokens_of(html: str | None) -> list[tuple[int, int, bool, str | None]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._flush()
    return page.tokens


def template_places(tokens: list[int], classes: list[list[int]]) -> set[int]:
    """The places of a page's tokens that its host's classes fix, wider classes first."""
    belongs = {t: k for k, members in enumerate(classes) for t in members}
    found: dict[int, list[int]] = {}
    for place, token in enumerate(tokens):
        if token in belongs:
            found.setdefault(belongs[token], []).append(place)
    fixed: set[int] = set()
    gaps: list[tuple[int, int]] = []
    for k in sorted(found, key=lambda k: found[k][0] - found[k][-1]):
        members, places = classes[k], found[k]
        # the class repeats: each of its tokens in turn, or each token several times before the next
        times = len(places) // len(members)
        rounds = [tokens[p] for p in places]
        if not times or rounds not in (members * times, [t for t in members for _ in range(times)]):
            continue
        # it nests: no wider class has a token on both sides of its own ends within a gap that it leaves
        span = places[0], places[-1]
        if any(a < span[0] <= b < span[1] or span[0] < a <= span[1] < b for a, b in gaps):
            continue
        gaps.append(span)
        fixed.update(places)
    return fixed


def main_text(html: str | None, classes: list[list[int]]) -> str:
    """The slots of the main elements, or of the body, joined by line ends.

    In a main element the template is the lesser part of the text; where it is more, the pages are copies of
    one article, which stays whole.
    """
    tokens = tokens_of(html)
    fixed = template_places([t for t, *_ in tokens], classes) if classes else set()
    blocks = [(main, text, place in fixed) for place, (_, main, aside, text) in enumerate(tokens) if text is not None and not aside]
    if any(main for main, *_ in blocks):
        blocks = [x for x in blocks if x[0]]
        framed, size = Counter(), Counter()
        for main, text, fix in blocks:
            size[main] += len(text)
            framed[main] += len(text) * fix
        blocks = [(main, text, fix and 2 * framed[main] < size[main]) for main, text, fix in blocks]
    return "\n".join(text for _, text, fix in blocks if not fix)


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, classes)``: the valid classes of each host, each a list of tokens in order. ``pages`` is ``page_id, url, html, host``."""
    shared.small_batches(pages.sparkSession)

    def marked(batches):
        signed = lambda x: x - 2**64 if x >> 63 else x
        for batch in batches:
            rows = []
            for host, page_id, html in zip(batch.column("host").to_pylist(), batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
                count, place = Counter(), {}
                for at, (token, *_) in enumerate(tokens_of(html.as_py())):
                    count[token] += 1
                    place.setdefault(token, at)
                for token, n in count.items():
                    rows.append((host, signed(token), signed(xxh3_64_intdigest(f"{page_id}:{n}".encode())), place[token]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "token", "mark", "place"])

    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    tokens = pages.select("page_id", "html", "host").mapInArrow(marked, "host string, token long, mark long, place long")
    vectors = tokens.groupBy("host", "token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("mark").alias("vector"), F.avg("place").alias("place"))
    wide = vectors.join(counts, "host").where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("pages")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])
    classes = wide.groupBy("host", "n", "vector").agg(ordered.alias("tokens")).where(F.size("tokens") >= LEAST_CLASS)
    # tokens on at least LEAST_SHARE of a host's pages: no more than a page or two holds
    return classes.groupBy("host").agg(F.collect_list("tokens").alias("classes"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page.

    A null html is an empty one and gives an empty text; a null url has the empty host; repeated rows come
    back each; pages of a host with fewer than ``LEAST_PAGES`` pages are read without a template; extra
    columns are ignored. A page of any length or depth is read whole. Character references are decoded, white space inside a block (an element that
    starts on a line of its own) becomes one space, and blocks are joined by line ends.
    """
    shared.small_batches(pages.sparkSession)
    slim = _pages(pages)
    found = shared.saved(templates(slim), "templates")

    def task(batches):
        known: tuple[object, list[list[int]]] = (None, [])
        for batch in batches:
            texts = []
            for host, html, template in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("classes"), strict=True):
                if host != known[0]:
                    known = (host, [[t % 2**64 for t in c] for c in template.as_py() or ()])
                texts.append(main_text(html.as_py(), known[1]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.join(found, "host", "left").mapInArrow(task, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
