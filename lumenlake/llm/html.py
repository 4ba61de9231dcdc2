"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream (tags, texts) is folded into a tree of elements whose runs of like siblings are one repeated group.
Streams of one host are aligned one after the other: elements that match are merged, those that miss on one side become
optional, neighbours that repeat become a group, texts that differ become a text slot. Every task folds its own pages,
parts of a host are merged over salts, then those over the host: all pages take part and no task sees a host's pages at once.
Where pages of a host differ in the order of like elements, the wrapper can depend on the order of merging. A host's wrapper names the path to its main region:
the article or main element, or else the smallest element that holds most of the slots' text.

Tags are read in one pass over the page; elements nested deeper than DEPTH are read as text of the one at that depth.

Defined cases: null and empty html give an empty text; a page that its wrapper does not fit is read with a wrapper of its own;
pages with a null or broken url share the host ''; repeated rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

# Names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script|style|noscript|template|textarea|svg|iframe|select"
ASIDE = frozenset("nav header footer aside form menu dialog button head script style noscript template textarea svg iframe select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Names of class, id or role for what is not the article.
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer cookie cookies consent notice notices comment comments disqus share sharing social related newsletter subscribe signup login popup modal widget toolbar pagination".split())

COMMENTS = frozenset("comment comments disqus".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>|([^>]*)>)|([^<]+|<)", re.S | re.I)
#: Elements nested deeper are read as part of the one at this depth: their text stays, block by block.
DEPTH = 200
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Attributes one by one, so that names are never sought in values.
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAYBE_HIDDEN = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[a-z]+")
#: Salts for a host's parts; a wrapper keeps its texts only as hashes and lengths.
SALTS, HOSTS_IN_TASK = 32, 2_000
#: Wrappers are broadcast up to this number of hosts; beyond it they are joined.
BROADCAST_HOSTS = 20_000


class Node:
    """An element; aside is 2 if a name of it says that it is not the article, 1 if only a part of a name does (no-sidebar)."""

    __slots__ = ("tag", "kids", "aside")

    def __init__(self, tag: str, aside: int = 0):
        self.tag, self.kids, self.aside = tag, [], aside


def hidden(attrs: str) -> bool:
    """Whether a tag has the attribute hidden (whatever its value), aria-hidden with the value true, or a style that shows nothing."""
    if not _MAYBE_HIDDEN.search(attrs):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), entities.unescape(a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree; text tokens are strings. Asides are one leaf tagged '-' (settled). End tags that HTML lets authors omit are
    implied."""
    root = Node("#")
    stack = [root]
    skip: list[str] = []
    deep: list[str] = []
    open_deep: Counter[str] = Counter()
    end = page.rfind(">") + 1  # after it there is no tag; so each pattern below finds its end and none is sought twice
    tail = page[end:]
    tail = tail[: tail.find("<!--")] if "<!--" in tail else tail
    for raw, close, name, attrs, rough, text in itertools.chain((m.groups() for m in _TOKEN.finditer(page, 0, end)), [(None, None, None, None, None, tail)] if tail else []):
        if raw:
            continue
        if text is not None:
            if not skip:
                stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
            continue
        if name is None:
            continue
        name, attrs = name.lower(), attrs if attrs is not None else rough
        if skip:
            if close and name in skip:
                while skip.pop() != name:
                    pass
            elif not close and name not in VOID and name == skip[0]:
                skip.append(name)
            continue
        if close and open_deep[name]:
            while True:
                last = deep.pop()
                open_deep[last] -= 1
                if last == name:
                    break
            if name not in INLINE:
                stack[-1].kids.append("\n")
            continue
        if close:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag.partition(".")[0] == name), 0)
            if at:
                del stack[at:]
                deep.clear()
                open_deep.clear()
            continue
        if name in CLOSES_P and not deep:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag.partition(".")[0] == "p"), 0)
            if at and all(n.tag.partition(".")[0] in INLINE for n in stack[at + 1 :]):
                del stack[at:]
        elif name in ITEMS and not deep:
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag.partition(".")[0]
                if t in ITEMS[name]:
                    break
                if t == name or (name in ("dt", "dd") and t in ("dt", "dd")) or (name in ("td", "th") and t in ("td", "th")):
                    del stack[i:]
                    break
        named = [a or b or c for a, b, c in _NAMED.findall(attrs)] if "=" in attrs else []
        names = set(" ".join(named).lower().split())
        words = set(_WORD.findall(" ".join(named).lower()))
        inside = any(n.tag.partition(".")[0] in ("article", "main") for n in stack)
        if (name in ASIDE and not (name == "header" and inside)) or (name not in ("html", "body", "article", "main") and attrs and hidden(attrs)):
            stack[-1].kids.append(Node("-"))
            if name not in VOID:
                skip = [name]
            continue
        aside = 2 if names & ASIDE_WORDS else 1 if words & ASIDE_WORDS and not inside else 0
        if name in ("html", "body", "main") or (name == "article" and not (aside == 2 and (inside or names & COMMENTS))):
            aside = 0
        if aside == 2 and names & COMMENTS:
            aside = 3
        if len(stack) > DEPTH:
            if name not in INLINE:
                stack[-1].kids.append("\n")
            if name not in VOID and not attrs.endswith("/"):
                deep.append(name)
                open_deep[name] += 1
            continue
        node = Node(name if name in ("html", "body") or not named else name + "." + ".".join(sorted(words)), aside)
        stack[-1].kids.append(node)
        if name not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return settled(root)


def settled(root: Node) -> Node:
    """The tree with its asides made leaves. Reader comments always are. What is named an aside stays if it holds an article or a
    main element or half of the page's text; what only has such a word within a name, also if it holds an h1."""
    order: list[tuple[Node, Node | None]] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        x, parent = stack.pop()
        order.append((x, parent))
        stack += [(k, x) for k in x.kids if isinstance(k, Node)]
    mass: dict[int, int] = {}
    holds: dict[int, int] = {}  # 1: an h1, 2: an article or main
    for x, parent in reversed(order):  # what is below comes first
        mine = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + mass.get(id(x), 0)
        name = x.tag.partition(".")[0]
        has = max(holds.get(id(x), 0), 2 if name in ("article", "main") and not x.aside else 1 if name == "h1" else 0)
        mass[id(x)], holds[id(x)] = mine, has
        if parent is not None and x.aside < 3:
            mass[id(parent)] = mass.get(id(parent), 0) + mine
            holds[id(parent)] = max(holds.get(id(parent), 0), has)
    whole = mass[id(root)]
    for x, _ in order:
        if x.aside == 3 or (x.aside and 2 * mass[id(x)] < whole and holds[id(x)] < x.aside):
            x.tag, x.kids = "-", []
    return root


def text_of(node: Node) -> str:
    """All text below node, asides left out: blocks part words, inline elements do not."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        inline = x.tag.partition(".")[0] in INLINE
        if not inline:
            out.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.kids))
    return " ".join("".join(out).split())


# A wrapper: [tag, repeated, optional, pages, texts, kids]; texts is [characters, hash of the one text or None for a slot].


def skeleton(node: Node) -> list:
    """The wrapper of one page: inline elements dissolve into their parent's text."""
    chars, kids = 0, []
    text: list[str] = []
    stack: list = list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            text.append(k)
            chars += len(k.strip())
        elif k.tag.partition(".")[0] in INLINE:
            stack.extend(reversed(k.kids))
        elif k.tag != "-":
            kids.append(k)
    word = " ".join("".join(text).split())
    w = [node.tag, False, False, 1, [chars, hash_text(word) if word else 0], []]
    for k in kids:
        _append(w[5], skeleton(k))
    return w


def hash_text(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode("utf-8", "replace")) + 1


def _append(kids: list, w: list) -> None:
    """Adds a sibling; a run of like siblings is one repeated group."""
    if kids and kids[-1][0] == w[0]:
        pages = max(kids[-1][3], w[3])
        kids[-1] = merge(kids[-1], w)
        kids[-1][1], kids[-1][3] = True, pages
    else:
        kids.append(w)


#: Cells of the table that two runs of siblings are aligned by; longer ones are aligned in one pass.
CELLS = 250_000


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: like ends first, then the longest one of what lies between; where that is too long for a
    table, each tag with its next like one, which takes time in proportion."""
    lo, n, m = 0, len(x), len(y)
    while lo < min(n, m) and x[lo] == y[lo]:
        lo += 1
    while n > lo and m > lo and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(lo)]
    a, b = x[lo:n], y[lo:m]
    if len(a) * len(b) > CELLS:
        at: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            at.setdefault(b[j], []).append(j)
        j = -1
        for i, tag in enumerate(a):
            later = at.get(tag, [])
            while later and later[-1] <= j:
                later.pop()
            if later and later[-1] - j <= len(a) - i + 16:  # not so far that little of the rest is left
                j = later.pop()
                out.append((lo + i, lo + j))
    elif a and b:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(n + k, m + k) for k in range(len(x) - n)]


def merge(a: list, b: list) -> list:
    """Aligns two wrappers of one element: siblings in common by their longest common sequence, the others optional."""
    texts = [a[4][0] + b[4][0], a[4][1] if a[4][1] == b[4][1] else None]
    x, y = a[5], b[5]
    n, m = len(x), len(y)
    if [k[0] for k in x] == [k[0] for k in y]:
        kids = [merge(p, q) for p, q in zip(x, y, strict=True)]
    else:
        kids = []
        i = j = 0
        for p, q in [*_common([k[0] for k in x], [k[0] for k in y]), (n, m)]:
            for k in (*x[i:p], *y[j:q]):  # found on one side alone
                _append(kids, [*k[:2], True, *k[3:]])
            if p < n:
                _append(kids, merge(x[p], y[q]))
            i, j = p + 1, q + 1
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], texts, kids]


def _mass(w: list) -> int:
    """Characters in slots below w: one text found on several pages is the template's."""
    own = 0 if w[4][1] is not None and w[3] > 2 else w[4][0]
    return own + sum(map(_mass, w[5]))


def main_path(w: list) -> list[str]:
    """Tags from below the root to the main region: of the outermost article and main elements the one with the most text, and
    within it the one that holds more than half of that. Without any, the smallest element that holds most of the text."""

    def outermost(x: list, path: list[str]) -> list[tuple[int, list[str], list]]:
        if x[0].partition(".")[0] in ("article", "main") or ".main" in x[0]:
            return [(_mass(x), path, x)]
        return [f for k in x[5] for f in outermost(k, [*path, k[0]])]

    best, found = None, outermost(w, [])
    while found:
        mass, path, x = max(found, key=lambda f: f[0])  # of equals the first in the page
        if best is not None and 2 * mass <= best[0]:
            break
        best = (mass, path)
        found = [f for k in x[5] for f in outermost(k, [*path, k[0]])]
    if best is not None:
        return best[1]
    path, total = [], _mass(w)
    while w[5]:
        top = max(w[5], key=_mass)
        if top[1] or not total or _mass(top) < 0.7 * total or top[0].partition(".")[0] in ("p", "h1", "h2", "h3", "li", "pre"):
            break
        path.append(top[0])
        w = top
    return path


def region(root: Node, path: list[str]) -> list[Node]:
    at = [root]
    for tag in path:
        at = [k for n in at for k in _blocks(n) if k.tag == tag]
    return at


def _blocks(node: Node) -> list[Node]:
    out = []
    for k in node.kids:
        if isinstance(k, Node):
            out += _blocks(k) if k.tag.partition(".")[0] in INLINE else [k]
    return out


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, path: the main region of each host, as JSON, inferred from all its pages."""

    def fold(batches):
        known: dict[str, list] = {}

        def out():
            return pa.record_batch([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], ["host", "wrapper"])

        for b in batches:
            for h, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                w = skeleton(parse(page.as_py() or ""))
                known[h] = merge(known[h], w) if h in known else w
                if len(known) > HOSTS_IN_TASK:
                    yield out()
                    known.clear()
        if known:
            yield out()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        w = None
        for x in group["wrapper"].sort_values():
            w = json.loads(x) if w is None else merge(w, json.loads(x))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(w)]})

    def last(group: pd.DataFrame) -> pd.DataFrame:
        w = join(group)
        return pd.DataFrame({"host": w["host"], "path": [json.dumps(main_path(json.loads(w["wrapper"].iloc[0])))]})

    parts = pages.select(host(pages["url"]).alias("host"), pages["html"].cast("string").alias("html")).mapInArrow(fold, "host string, wrapper string")
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).applyInPandas(join, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(last, "host string, path string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    learned = C.stored(wrappers(slim), "wrappers")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    if learned.count() <= BROADCAST_HOSTS:
        joined = slim.withColumn("_host", host(F.col("url"))).join(F.broadcast(learned), F.col("_host") == F.col("host"), "left")
    else:
        spread = learned.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = slim.withColumn("_host", host(F.col("url"))).withColumn("_of", salt).join(spread, (F.col("_host") == F.col("host")) & (F.col("_of") == F.col("_salt")), "left")

    def rows(batches):
        for b in batches:
            out = []
            for page, path in zip(b.column("html"), b.column("path").to_pylist(), strict=True):
                root = parse(page.as_py() or "")
                at = region(root, json.loads(path)) if path else []
                text = " ".join(filter(None, map(text_of, at)))
                if not text:
                    text = " ".join(filter(None, map(text_of, region(root, main_path(skeleton(root))))))
                out.append(text)
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
