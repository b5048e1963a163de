"""Main text of web pages by consensus of host paths.

1. Every page is read into blocks of text, each with its containers (``body``,
   ``article``, ``main``, ``section``, ``div``, cells), outside of what is never main
   text: scripts, styles, forms, menus, headers, footers, asides, and elements
   whose role, class or id says navigation, notice, advert or comments.  Names of
   states (``no-sidebar``, ``comments-open``, ``hidden-xs``) say none of these.  Of
   such elements, those that hold a ``main``, or else the largest ``article`` if it has
   a quarter of the page's text outside of links, or else more than half of that
   text, are read as any other.  A container scores by the text below it, less by its links, more for what its
   tag and class promise, and decaying with each level.  The best one gives way to the outermost
   article around it, and then to its parent as long as what else the parent holds is
   headings and running text rather than links: so a title, a lead or a second part beside the
   longest one is not lost.  Repeated siblings named as posts, outside of the page's article, are a
   thread of readers' comments and no part of it.
2. A container's path is its chain of tags and classes with digits
   generalised.  Each page votes for the path of its best container; Spark sums
   the votes for each host.
3. Every page is read again and gives the blocks in the containers whose path
   won most votes among those of its host that it has; a page with none of them
   gives those of its own best container.

Votes are a table of (host, path).  Every path with ``SHARE`` of all votes of its
host wins, so a host has at most 1 / ``SHARE`` winning paths.  Up to ``HOSTS`` rows go to all executors; a larger table is joined by host
instead.  Pages of one host are never brought together otherwise.

Defined results: null or empty html, and pages without text, give an empty text;
a null url belongs to the empty host; repeated rows are extracted each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .url_rules import host_of

HOSTS = 500_000
#: The least share of a host's votes with which a path wins.
SHARE = 0.05
DECAY = 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template xmp noembed noframes".split())
#: Never text: what is not shown, or not as text.
HARD = RAW | frozenset("head button select svg canvas audio video".split())
DROPPED = HARD | frozenset("nav header footer aside form menu".split())
#: Of those, the ones that are no layout around a text, however much they hold.
NEVER = frozenset("nav header footer aside menu".split())
CONTAINERS = frozenset("html body article main section div td center figure details dialog".split())
BLOCKS = CONTAINERS | DROPPED | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr th hr address "
    "figcaption summary fieldset legend hgroup search".split())
#: Start tags that end an open element of these tags.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("html body article main section div td th table ul ol dl blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                  "toolbar status tooltip".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adslot|banners?|sponsors?|sponsored|promos?|promotions?|"
    r"cookies?|consent|gdpr|notices?|alerts?|disclaimers?|sidebars?|side-?bar|rail|nav|navs|navbar|navigation|menus?|"
    r"breadcrumbs?|footers?|foot|headers?|masthead|comments?|commentlist|disqus|replies|respond|share|sharing|social|"
    r"related|recommended|newsletters?|subscribe|subscription|popups?|modals?|overlays?|login|signup|paywall|"
    r"pagination|pager|toolbar|skip|hidden)(?:$|[\s_-])", re.I)
#: Names that tell the state of a page or layout, or where something is hidden.
STATE = re.compile(r"(?:no|not|non|has|have|with|without)[_-].+|.+[_-](?:open|opened|closed|free|enabled|disabled|on|off)|"
                   r"hidden[_-](?:xs|sm|md|lg|xl|xxl|phone|tablet|desktop|mobile|print)(?:[_-].*)?", re.I)
#: What the name of a container promises.
PROMISE = re.compile(r"(?:^|[\s_-])(?:articles?|content|entry|post|posts|story|text|main|prose|copy)(?:$|[\s_-])", re.I)
#: Siblings of one path with such a name are a thread where the page has an article beside them.
THREAD = re.compile(r"\.(?:[^/]*[._-])?(?:posts?|reply|replies|messages?|comments?|answers?|reviews?)(?:[._-][^/]*)?$")
#: Unlinked characters from which on a block counts as running text.
RUNNING = 25
HEADINGS = frozenset("h1 h2 h3".split())
WEIGHT = {"article": 2.0, "main": 1.5, "html": 0.4, "body": 0.5}

NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends the tag at ``at``, outside of quotes."""
    end = page.find(">", at)
    seen = at
    while end >= 0:
        for quote in "\"'":
            if page.count(quote, seen, end) % 2:
                close = page.find(quote, end)
                if close >= 0:
                    seen, end = close + 1, page.find(">", close + 1)
                    break
        else:
            return end
    return page.find(">", at)


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag)} if "=" in tag else {}


def _is_dropped(tag: str, attributes: dict[str, str], bare: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "dialog" and not attributes.get("open"):
        return True
    if not attributes and not bare:
        return False
    if attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden", "").lower() == "true" or bare:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    return any(BOILERPLATE.search(attributes[k]) and any(BOILERPLATE.search(x) and not STATE.fullmatch(x) for x in attributes[k].split())
               for k in ("class", "id") if k in attributes)


class Page:
    """Blocks (text, container, link characters) and containers (path, parent,
    weight) of one page."""

    def __init__(self, page: str | None):
        self.blocks: list[tuple[str, int, int]] = []
        self.titles: set[int] = set()  # blocks that are headings
        self.thread: list[bool] | None = None  # containers of a thread
        self.paths, self.parents, self.weights = [""], [-1], [WEIGHT["html"]]
        if page and (kept := self._read(page, frozenset())):
            self.__init__(None)
            self._read(page, kept)

    def _read(self, page: str, kept: frozenset[int]) -> frozenset[int]:
        """Reads the page; elements to drop are numbered, those in ``kept`` stay.
        Returns the numbers of those that should have stayed."""
        stack: list[tuple[str, int, list | None]] = []  # (tag, container before it, what it spans)
        box, links, dropped, hard = 0, 0, 0, 0
        seen, numbered = 0, 0  # characters outside of links, elements to drop
        spans: list[list] = []  # [tag or number, seen at its start, characters, dropped elements around it]
        around: list[int] = []
        parts: list[str] = []
        linked = 0

        def flush(title: bool = False):
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    if title:
                        self.titles.add(len(self.blocks))
                    self.blocks.append((text, box, min(linked, len(text))))
                parts, linked = [], 0

        def close(depth: int):
            """Ends the open elements from ``depth`` on."""
            nonlocal box, links, dropped, hard
            while len(stack) > depth:
                tag, before, span = stack.pop()
                if tag in BLOCKS and not dropped:
                    flush(tag in HEADINGS)
                if span:
                    span[2] = seen - span[1]
                if before == -2:
                    dropped -= 1
                    hard -= span is None
                    if span:
                        around.pop()
                elif tag == "a" and before == -3:
                    links -= 1
                elif before >= 0:
                    box = before

        def text(a: int, b: int):
            nonlocal linked, seen
            if not hard and not links and a < b:
                seen += len("".join(page[a:b].split()))
            if not dropped and a < b:
                t = page[a:b]
                t = entities.unescape(t) if "&" in t else t
                parts.append(t)
                linked += len(t) if links else 0

        at, size = 0, len(page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                text(at, size)
                break
            following = page[start + 1:start + 2]
            if following == "!" or following == "?":
                text(at, start)
                comment = page.startswith("<!--", start)
                end = page.find("-->" if comment else ">", start + (4 if comment else 1))
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            m = NAME.match(page, start + 1)
            if not m:
                text(at, start + 1)
                at = start + 1
                continue
            text(at, start)
            end = _tag_end(page, start)
            end = size if end < 0 else end
            tag = m[1].lower()
            at = end + 1
            if following == "/":
                if tag in ("p", "br"):  # an end without a start still parts blocks
                    if not dropped:
                        flush()
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                    if stack[depth][0] in SCOPE and tag not in BLOCKS:
                        break
                continue
            if tag in VOID:
                if tag == "hr" and not dropped:
                    flush()
                elif tag == "br" and not dropped:
                    parts.append("\n")
                continue
            source = page[m.end():end]
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                at = size if stop is None else _tag_end(page, stop.start()) + 1 or size
                continue
            if tag in BLOCKS:
                if not dropped:
                    flush()
                for depth in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in SCOPE:
                        break
            for depth in range(len(stack) - 1, -1, -1) if tag in ENDS else ():
                if stack[depth][0] in ENDS[tag]:
                    close(depth)
                    break
                if stack[depth][0] in SCOPE - set(ENDS[tag]) and not (tag in ("td", "th") and stack[depth][0] == "tr"):
                    break
            if source.endswith("/") and tag not in BLOCKS:
                continue
            attributes = _attributes(source)
            bare = bool(re.search(r"(?:^|\s)hidden(?:\s|$)", source)) if "hidden" in source and not hard else False
            if tag == "dialog" and re.search(r"(?:^|\s)open(?:\s|=|$)", source, re.I):
                attributes["open"] = "open"
            span = None
            if not hard and tag in ("article", "main"):
                span = [tag, seen, 0, list(around)]
                spans.append(span)
            drop = not hard and _is_dropped(tag, attributes, bare)
            if drop and tag not in HARD:
                number, numbered = numbered, numbered + 1
                if drop := number not in kept:
                    spans.append(span := [number, seen, 0, list(around), tag])
                    around.append(number)
            if drop:
                stack.append((tag, -2, span))
                dropped += 1
                hard += span is None
            elif tag in CONTAINERS and not dropped:
                stack.append((tag, box, span))
                classes = sorted(set(re.sub(r"\d+", "#", attributes.get("class", "").lower()).split()))
                weight = WEIGHT.get(tag, 1.0)
                if weight == 1.0 and any(PROMISE.search(attributes[k]) for k in ("class", "id") if k in attributes):
                    weight = 1.5
                self.paths.append("/".join([self.paths[box], ".".join([tag, *classes])]))
                self.parents.append(box)
                self.weights.append(weight)
                box = len(self.paths) - 1
            elif tag == "a" and not hard:
                stack.append((tag, -3, None))
                links += 1
            else:
                stack.append((tag, -1, span))
        close(0)
        flush()
        texts = [x for x in spans if isinstance(x[0], str) and x[2]]
        largest = max((x[2] for x in texts if x[0] == "article"), default=0)
        texts = [x for x in texts if x[0] == "main"] or [x for x in texts if x[2] == largest and 4 * largest >= seen]
        if texts:
            return frozenset(k for x in texts for k in x[3])
        return frozenset(x[0] for x in spans if not isinstance(x[0], str) and 2 * x[2] > seen and x[4] not in NEVER)

    def _tag(self, box: int) -> str:
        return self.paths[box].rpartition("/")[2].partition(".")[0]

    def _threads(self) -> list[bool]:
        """Which containers belong to a thread beside the page's article."""
        if self.thread is None:
            n = len(self.paths)
            self.thread = [False] * n
            article, plain = [False] * n, [0] * n
            for text, box, linked in self.blocks:
                plain[box] += len(text) - linked
            groups: dict[tuple[int, str], int] = {}
            for box in range(1, n):
                article[box] = article[self.parents[box]] or self._tag(box) == "article"
                if not article[box] and THREAD.search(self.paths[box]):
                    key = self.parents[box], self.paths[box]
                    groups[key] = groups.get(key, 0) + 1
            if groups:
                for box in range(1, n):
                    up = self.parents[box]
                    self.thread[box] = self.thread[up] or groups.get((up, self.paths[box]), 0) > 1
                if not any(article[box] and not self.thread[box] and plain[box] for box in range(n)):
                    self.thread = [False] * n
        return self.thread

    def best(self) -> tuple[str, float] | None:
        """(path, score) of the best container."""
        thread = self._threads()
        score, running, links = [0.0] * len(self.paths), [0] * len(self.paths), [0] * len(self.paths)
        found = False
        for k, (text, box, linked) in enumerate(self.blocks):
            if thread[box]:
                continue
            found = True
            plain = len(text) - linked
            score[box] += plain + 0.1 * linked
            links[box] += linked
            if plain > linked * 2 and (plain >= RUNNING or k in self.titles):
                running[box] += plain
        if not found:
            return None
        for box in range(len(self.paths) - 1, 0, -1):  # parents come before their children
            up = self.parents[box]
            score[up] += DECAY * score[box]
            running[up] += running[box]
            links[up] += links[box]
        top = max(range(len(score)), key=lambda b: (score[b] * self.weights[b], -b))
        value = score[top] * self.weights[top]
        box = top
        while box > 0:
            if self._tag(box) == "article":
                top = box
            box = self.parents[box]
        box = top
        while box > 0:
            up = self.parents[box]
            more, around = running[up] - running[top], links[up] - links[top]
            if around > more:
                break
            if more > 0:
                top = up
            box = up
        return self.paths[top], value

    def text(self, winners: list[str]) -> str:
        """The blocks in the containers of the first winning path on this page."""
        here = set(self.paths)
        own = self.best()
        if own is None:
            return ""
        path = next((p for p in winners if p in here), own[0])
        inside, thread = [False] * len(self.paths), self._threads()
        for box, p in enumerate(self.paths):
            inside[box] = (p == path or (box > 0 and inside[self.parents[box]])) and not thread[box]
        out = "\n".join(t for t, box, _ in self.blocks if inside[box])
        return out or self.text([own[0]]) if path != own[0] else out


def votes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, path, n, score): the pages of each host that voted for a path."""
    import pyarrow as pa

    def make():
        def work(batch):
            sums: dict[tuple, list] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column(html_col).to_pylist()):
                if best := Page(page).best():
                    s = sums.setdefault((host, best[0]), [0, 0.0])
                    s[0] += 1
                    s[1] += best[1]
            keys = sorted(sums)
            return {"host": pa.array([k[0] for k in keys], pa.string()), "path": pa.array([k[1] for k in keys], pa.string()),
                    "n": pa.array([sums[k][0] for k in keys], pa.int64()),
                    "score": pa.array([sums[k][1] for k in keys], pa.float64())}

        return work

    return (map_arrow(pages.select("host", html_col), make, "path string, n long, score double", ["host"], 256)
            .groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("score").alias("score")))


def winners(counted: DataFrame) -> DataFrame:
    """(host, paths): for each host its winning paths, most votes first.  Reads
    ``counted`` twice."""
    total = counted.groupBy("host").agg(F.sum("n").alias("all"))
    best = F.struct(-F.col("n"), -F.round("score", 3), "path")  # at most 1 / SHARE of a host
    return (counted.join(total.withColumnRenamed("host", "of"), F.expr("host <=> of")).where(F.col("n") >= SHARE * F.col("all"))
            .groupBy("host").agg(F.transform(F.array_sort(F.collect_list(best)), lambda x: x["path"]).alias("paths")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            most_hosts: int = HOSTS) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    import pyarrow as pa

    from .common import written

    hosted = pages.select(id_col, url_col, html_col, host_of(F.col(url_col)).alias("host"))
    won = written(winners(written(votes(hosted, html_col), "host-votes")), "host-paths")
    shared = None
    if won.count() <= most_hosts:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: list(r.paths) for r in won.collect()})
    else:
        hosted = hosted.join(won, "host", "left")

    def make():
        def work(batch):
            hosts = batch.column("host").to_pylist()
            chosen = [shared.value.get(h) or [] for h in hosts] if shared else [p or [] for p in batch.column("paths").to_pylist()]
            texts = [Page(page).text(paths) for page, paths in zip(batch.column(html_col).to_pylist(), chosen)]
            return {id_col: batch.column(id_col), url_col: batch.column(url_col), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(map(len, texts), pa.int64())}

        return work

    return map_arrow(hosted, make, "text string, n_chars long", [id_col, url_col], 256)
