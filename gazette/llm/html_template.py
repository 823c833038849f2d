"""Main text of web pages by template deduction over the pages of a host.

Pages are read as tokens: tags and text strings (one block's text), each told
apart by the containers around it. Tokens of a host with the same occurrence vector (how often in which
page) form an equivalence class. A class is valid if it is large
(``MIN_CLASS`` tags and words of strings) and frequent (``MIN_PAGES`` pages and ``MIN_SHARE`` of the
host's pages). Valid classes make up the host's template, nested by their
containers: their tags frame the slots, their strings are the fixed text. What
is left in the slots is the page's own text. A slot is dropped if its container
says so (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts), or if over the host it holds mostly links. If most pages of
the host frame an ``article`` or ``main``, or it holds half of a page's own
text, the text is all that these hold: template and link rules are for what
stands outside. Pages of a host with equal bodies (all strings that are neither
excluded nor links outside an article) count as one page, so copies of a page are
no evidence of a template.

Scale: the vector of a token is never built. Each page becomes one packed row of
token keys; of equal bodies one row stays (partial aggregate by host and body).
The signature, the XOR of hash(body, count) over the bodies, is summed map-side
per batch and then by (host, token), so a host with a third of all pages is
spread over its bodies, tokens and tasks. Template rows are bounded by the tags and strings of a page; the table is
broadcast up to ``BROADCAST_ROWS`` rows and joined by host beyond that. Pages
stay where they are.

Defined results: null html gives the empty text; a null or odd url belongs to
the empty host; hosts of fewer than ``MIN_PAGES`` pages have no template and
are read by their containers alone; unclosed and stray tags, cut pages and very
long ones are read as far as they go; repeated rows each get their row and count
as one page of the host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CLASS = 3
MIN_PAGES = 4
MIN_SHARE = 0.5
LINK_SHARE = 0.5
LINK_BODIES = 1000           # a path of links counts if one in so many bodies of the host has it
BROADCAST_ROWS = 200_000

# Element roles.
SKIPPED = "script style noscript template svg math iframe object canvas select textarea button audio video".split()
BOILERPLATE = set("nav footer aside form head title menu dialog".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var".split())
CONTAINERS = set("div section article main nav header footer aside form ul ol dl table head title menu dialog details figure "
                 "blockquote fieldset".split())
NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widget|"
    r"related|recommended|share|sharing|social|comments?|discussion|disqus|repl(?:y|ies)|respond|footer|pagination|pager|"
    r"copyright|disclaimer|search|complementary|contentinfo)(?:$|[^a-z])")
HEADER = re.compile(r"(?:^|[^a-z])(?:header|masthead|topbar|toolbar)(?:$|[^a-z])")

WORD = re.compile(r"[a-z]+")
WRAPPERS = CONTAINERS | {"td", "tr", "tbody"}

TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(?P<skip>" + "|".join(SKIPPED) + r")\b.*?(?:</(?P=skip)\s*>|\Z)"
    r"|(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|/?[a-zA-Z][^>]*(?:>|\Z)"
    r"|[!?][^>]*(?:>|\Z))", re.DOTALL | re.IGNORECASE)
NAME = re.compile(r"""\b(class|id|role|itemprop|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def is_noise(names: str) -> bool:
    """If one of the names consists of noise words only (``sidebar``, ``cookie-notice``; not ``has-sidebar``)."""
    return any(parts and all(NOISE.search(x) or HEADER.search(x) for x in parts) for parts in map(WORD.findall, names.split()))


def short_name(name: str) -> str:
    """Names longer than 60 characters as their beginning and a hash, so that different ones stay different."""
    return name if len(name) <= 60 else f"{name[:40]}~{xxhash.xxh64_hexdigest(name)}"


class Page:
    """One pass over a page: ``blocks`` (path, excluded, in article, text, link characters) and ``tags`` (path and tag).

    A wrapper with a noise word in its names is judged when the page is read,
    see ``_judge``; ``html``, ``body`` and ``main`` are never excluded by names.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, bool, str, int]] = []
        self.tags: list[str] = []
        self.stack: list[tuple[str, str, bool, bool, int]] = []   # tag, path, excluded, in article, named wrapper
        self.path, self.out, self.article, self.named = "", False, False, -1
        self.wrappers: list[list] = []                   # outer one, name is noise, holds main, holds articles
        self.within: list[int] = []                      # named wrapper of each block
        self.held: list[str] = []
        self.place = ("", False, False)                  # where the held text began
        self.begun = -1
        self.link = self.linked = 0
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag:
                tag = tag.lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._open(tag, m["attrs"])
        if at < len(html):
            self._text(html[at:])
        self._flush()
        if self.wrappers:
            self._judge()

    def _text(self, text: str) -> None:
        if self.out and self.stack[-1][0] in INLINE:     # an advert or the like inside a line
            return
        if not self.held:
            self.place, self.begun = (self.path, self.out, self.article), self.named
        self.held.append(text)
        if self.link:
            self.linked += len(text)

    def _flush(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            if text:
                self.blocks.append((*self.place, text, min(self.linked, len(text))))
                self.within.append(self.begun)
            self.held.clear()
        self.linked = 0

    def _set(self) -> None:
        _, self.path, self.out, self.article, self.named = self.stack[-1] if self.stack else ("", "", False, False, -1)

    def _judge(self) -> None:
        """Exclude the named wrappers, but not those around the page's content.

        Text counts without links. A wrapper of ``main`` stays. One of articles
        stays if they are no shorter than the article text around it, one without if
        it holds more text than there is around it. One whose name is noise has to hold
        all article text and more text than all that stays. (An article whose
        name is not noise needs no judgement.)
        """
        n = len(self.wrappers)
        held = [[0, 0] for _ in range(n + 1)]            # text, article text; the last one is the text in no wrapper
        for (_, out, inside, text, linked), w in zip(self.blocks, self.within, strict=True):
            if not out:
                held[w][0] += len(text) - linked
                held[w][1] += (len(text) - linked) * inside
        around: list[list[int]] = []
        direct = [list(x) for x in held]
        for outer, *_ in self.wrappers:
            more = around[outer] if outer >= 0 else [0, 0]
            around.append([more[0] + direct[outer][0], more[1] + direct[outer][1]])
        stays = [False] * n

        def stay(i: int) -> None:
            stays[i] = True
            held[self.wrappers[i][0]][0] += held[i][0]
            held[self.wrappers[i][0]][1] += held[i][1]

        for i in range(n - 1, -1, -1):
            _, noise, main, articles = self.wrappers[i]
            if main or not noise and (held[i][1] >= around[i][1] if articles else held[i][0] > around[i][0]):
                stay(i)
        text, framed = held[-1]                          # what stays
        for i in range(n - 1, -1, -1):
            if not stays[i] and self.wrappers[i][1] and self.wrappers[i][3] and not framed and held[i][0] > text:
                stay(i)
        gone: list[bool] = []
        for i, (outer, *_) in enumerate(self.wrappers):
            gone.append(not stays[i] or outer >= 0 and gone[outer])
        self.blocks = [(path, out or w >= 0 and gone[w], inside, text, linked)
                       for (path, out, inside, text, linked), w in zip(self.blocks, self.within, strict=True)]

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "a":
            self.link += 1
        if tag in INLINE and not attrs:
            return
        names = ""
        hidden = False
        if attrs:
            names = " ".join((b or c or d) for a, b, c, d in NAME.findall(attrs) if a.lower() != "style").lower()
            hidden = bool(HIDDEN.search(attrs))
        noisy = hidden or bool(names and NOISE.search(names))
        if tag in INLINE and not noisy:
            return
        if tag not in INLINE:
            self._flush()
            if self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
                self._set()
            if tag == "body":                            # whatever the head left open ends here
                self.stack.clear()
                self._set()
        label = tag + ("." + short_name(re.sub(r"[\d\s]+", ".", names)) if names else "")
        self.tags.append(f"{self.path}<{label}>")
        if tag in VOID or attrs.endswith("/"):
            return
        inside = self.article or tag in ("article", "main") or "articlebody" in names or " main " in f" {names} "
        titled = bool(names and HEADER.search(names))
        excluded = self.out or tag in BOILERPLATE or hidden or tag == "header" and not inside
        named = self.named
        if not excluded:
            starts = tag == "article" or inside and not self.article
            noise = (noisy or titled and not inside) and tag not in ("html", "body", "main")
            if noise and (tag in WRAPPERS or starts):
                own = is_noise(names)
                if own or not starts:
                    self.wrappers.append([named, own, False, starts])
                    named = len(self.wrappers) - 1
                noise = False
            excluded = noise
            outer = named if starts or tag == "main" else -1
            while outer >= 0:                            # the wrappers around an article or main
                self.wrappers[outer][2 if tag == "main" else 3] = True
                outer = -1 if self.wrappers[outer][1] and tag != "main" else self.wrappers[outer][0]
        if tag in CONTAINERS or excluded != self.out or inside != self.article or named != self.named:
            self.stack.append((tag, f"{self.path}>{label}", excluded, inside, named))
            self._set()

    def _close(self, tag: str) -> None:
        if tag == "a" and self.link:
            self.link -= 1
        if tag not in INLINE:
            self._flush()
            self.tags.append(f"{self.path}</{tag}>")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                self._set()
                break
            if self.stack[i][0] in ("article", "main"):           # a stray end tag does not close the article
                break


def token_key(path: str, text: str) -> int:
    """Signed 64-bit key of a string or tag in its containers."""
    return xxhash.xxh64_intdigest(f"{path}\x00{text}") - (1 << 63)


def _tokens(page: Page) -> dict[int, tuple[int, int]]:
    """How often each token occurs in the page, and its number of words (a tag counts as one)."""
    out = {token_key(path, text): (n, text.count(" ") + 1)
           for (path, text), n in Counter([(path, text) for path, _, _, text, _ in page.blocks]).items()}
    for t, n in Counter(page.tags).items():
        out[token_key("", t)] = (n, 1)
    return out


_VECTORS = "host string, token long, sig long, pages long, total long, chars long, linked long, article long"
_NAMES = ["host", "token", "sig", "pages", "total", "chars", "linked", "article"]
_PACKED = np.dtype([("token", "<i8"), ("n", "<i4"), ("chars", "<i4"), ("linked", "<i4")])


def body_key(page: Page) -> int:
    """Key of the page's body: its strings that are not excluded, without links outside the article."""
    return token_key("body", "\n".join([text for _, out, inside, text, linked in page.blocks
                                        if not out and (inside or linked <= LINK_SHARE * len(text))]))


def _page_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, body, packed, article`` of each page; ``packed`` holds its tokens (n > 0, chars their words) and the links of its paths (n = 0)."""
    for b in batches:
        hosts, htmls = b.column("host"), b.column("html").to_pylist()
        for a in range(0, len(htmls), 2_000):
            out: list[tuple] = []
            for html in htmls[a:a + 2_000]:
                page = Page(html or "")
                paths: dict[str, list[int]] = {}
                framed = 0
                for path, excluded, article, text, linked in page.blocks:
                    framed |= article
                    if not excluded:
                        row = paths.setdefault(path, [0, 0])
                        row[0] += len(text)
                        row[1] += linked
                rows = [(t, n, size, 0) for t, (n, size) in _tokens(page).items()]
                rows += [(token_key("path", p), 0, c, k) for p, (c, k) in paths.items()]
                out.append((body_key(page), np.array(sorted(rows), _PACKED).tobytes(), int(framed)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([hosts.slice(a, len(out)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.int64())], ["host", "body", "packed", "article"])


def _vector_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: partial occurrence vectors, link shares of paths and numbers of bodies (token 0) of each host."""
    for b in batches:
        hosts: dict[str, dict[int, list[int]]] = {}
        for host, body, packed, framed in zip(*(b.column(c).to_pylist() for c in ("host", "body", "packed", "article")), strict=True):
            own = hosts.setdefault(host, {})
            for token, n, chars, linked in np.frombuffer(packed, _PACKED).tolist():
                row = own.get(token)
                if row is None:
                    row = own[token] = [0, 0, 0, 0, 0, 0]
                if n:
                    row[0] ^= xxhash.xxh64_intdigest(f"{body}/{n}") - (1 << 63)
                    row[1] += 1
                row[2] += n or 1                             # of a path: the bodies that have it
                row[3] += chars
                row[4] += linked
            row = own.setdefault(0, [0, 0, 0, 0, 0, 0])
            row[1] += 1
            row[5] += framed
        rows = [(h, t, *r) for h, own in hosts.items() for t, r in own.items()]
        for a in range(0, len(rows), 50_000):
            cols = list(zip(*rows[a:a + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], _NAMES)


def templates(pages: DataFrame, min_class: int = MIN_CLASS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, tokens, link_paths, article`` of every host with enough pages; ``pages`` has host, html."""
    bodies = (pages.select("host", "html").mapInArrow(_page_pass, "host string, body long, packed binary, article long")
              .groupBy("host", "body").agg(F.min(F.struct("packed", "article")).alias("p"))
              .select("host", "body", "p.packed", "p.article"))
    v = (bodies.mapInArrow(_vector_pass, _VECTORS).groupBy("host", "token")
         .agg(F.bit_xor("sig").alias("sig"), *[F.sum(c).alias(c) for c in _NAMES[3:]]).checkpoint())
    hosts = v.filter(F.col("token") == 0).filter(F.col("pages") >= min_pages).select(
        "host", F.col("pages").alias("n"), F.col("article").alias("n_article"))
    frequent = v.filter((F.col("token") != 0) & (F.col("pages") >= min_pages)).join(hosts.select("host", "n"), "host").filter(
        F.col("pages") >= F.col("n") * min_share)
    # tokens of one occurrence vector; what is frequent on a host is bounded by the size of its pages
    classes = frequent.groupBy("host", "sig", "pages", "total").agg(
        F.collect_list("token").alias("c"), F.sum(F.col("chars") / F.col("pages")).alias("size")).filter(F.col("size") >= min_class)
    tokens = classes.groupBy("host").agg(F.flatten(F.collect_list("c")).alias("tokens"))
    # a rare path is judged block by block; so a host has at most LINK_BODIES paths for each path of a page
    links = v.filter((F.col("pages") == 0) & (F.col("linked") > LINK_SHARE * F.col("chars")) & (F.col("total") >= min_pages)).join(
        hosts.select("host", "n"), "host").filter(F.col("total") * LINK_BODIES >= F.col("n")).groupBy("host").agg(
        F.collect_list("token").alias("link_paths"))
    return (hosts.join(tokens, "host", "left").join(links, "host", "left")
            .select("host", "tokens", "link_paths", (F.col("n_article") >= F.col("n") * min_share).alias("article")))


def main_text(page: Page, tokens: frozenset[int], link_paths: frozenset[int], article: bool | None) -> tuple[str, int]:
    """``(text, slots used)`` of a page under its host's template."""
    own, whole = [], []
    for path, out, inside, text, linked in page.blocks:
        if out:
            continue
        if inside:
            whole.append((inside, text))
        if link_paths and token_key("path", path) in link_paths:
            continue
        if linked > LINK_SHARE * len(text) and not inside:
            continue
        if tokens and token_key(path, text) in tokens:
            continue                                     # fixed text of the template
        own.append((inside, text))
    framed = sum(len(t) for _, t in whole)
    rest = sum(len(t) for i, t in own if not i)
    # an article of fixed strings only (teasers) is the text if it is no shorter than the rest
    if framed and (framed >= rest or article is not False and any(i for i, _ in own)):
        own = whole
    return "\n".join(t for _, t in own), len(own)


def _extract_pass(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, known = None, (frozenset(), frozenset(), None)
        for b in batches:
            texts, slots = [], []
            extra = [b.column(c) for c in ("_tokens", "_links", "_article")]
            for k, (h, html) in enumerate(zip(b.column("_host").to_pylist(), b.column("_html").to_pylist(), strict=True)):
                if h != host:
                    t, p, a = (c[k].as_py() for c in extra)
                    host, known = h, (frozenset(t or ()), frozenset(p or ()), a)
                text, n = main_text(Page(html or ""), *known)
                texts.append(text)
                slots.append(n)
            keep = [b.column(i) for i in range(len(schema) - 3)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array(slots, pa.int64())], schema=schema)
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``text, n_chars, n_slots`` of every row of ``pages``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from gazette.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(pages.sparkSession)
    keep = [id_col, url_col] if keep is None else keep
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    src = pages.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], host.alias("_host"),
                       F.col(html_col).alias("_html"))
    found = templates(src.select(F.col("_host").alias("host"), F.col("_html").alias("html"))).checkpoint()
    rows = found.agg(F.coalesce(F.sum(F.size(F.coalesce("tokens", F.array())) + F.size(F.coalesce("link_paths", F.array())) + 1),
                                F.lit(0))).first()[0]
    table = found.select(F.col("host").alias("_host"), F.col("tokens").alias("_tokens"), F.col("link_paths").alias("_links"),
                         F.col("article").alias("_article"))
    both = src.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, "_host", "left")
    both = both.select(*[f"_k{i}" for i in range(len(keep))], "_host", "_html", "_tokens", "_links", "_article")
    ddl = ("".join(f"_k{i} {f.dataType.simpleString()}, " for i, f in enumerate(src.schema.fields[:len(keep)]))
           + "text string, n_chars long, n_slots long")
    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], ddl).schema)
    out = both.mapInArrow(_extract_pass(schema), ddl)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars", "n_slots")
