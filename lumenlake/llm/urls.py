"""URL filters: rules of hosts and paths first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where no letter (a to z, or any byte beyond ASCII) stands on either side of it. One strict term, or `several`
distinct soft terms, in host and path reject a url; query and fragment are not read. A url that is null or has no :// has an
empty host and path: no rule fits it and nothing is found in it, so it is allowed. Rows that repeat are judged each; an empty
table gives no rows. Of the input only the key and the url are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm import common as C

# The vocabulary, in small letters.
STRICT = (
    "anal", "blowjob", "bukkake", "camgirls", "cumshot", "escorts", "fetish", "gangbang", "hardcore", "hentai", "keygen",
    "milf", "nsfw", "onlyfans", "phishing", "porn", "porno", "pornstar", "sexcam", "sexchat", "spam", "spam-farm", "viagra",
    "warez", "xrated", "x-rated", "xvideos", "xxx",
)
SOFT = (
    "ads", "adult", "adserver", "affiliate", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "cracked", "crypto",
    "dating", "deals", "download", "escort", "free", "gambling", "hot", "jackpot", "loan", "loans", "lottery", "naked", "nude",
    "payday", "pharmacy", "pills", "poker", "popunder", "sex", "sexy", "slots", "torrent", "track", "tracker", "win", "x",
)

#: (action, host, path) of a rule.
Rule = tuple[str, str, str]
SPAN = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z in small letters) and the path of a url; both empty for null and where there is no ://."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass
class Automaton:
    """An Aho-Corasick machine over classes of bytes: the next state by (state, class), and the terms that end in a state."""

    terms: list[bytes]
    classes: np.ndarray
    step: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray

    @property
    def longest(self) -> int:
        return max(map(len, self.terms), default=1)


def automaton(terms: Sequence[bytes]) -> Automaton:
    """The machine of the terms (empty ones find nothing). It has at most as many states as the terms have bytes."""
    used = sorted({b for t in terms for b in t})
    classes = np.zeros(256, np.int64)
    classes[used] = range(1, len(used) + 1)
    child: list[dict[int, int]] = [{}]
    found: list[list[int]] = [[]]
    for i, t in enumerate(terms):
        at = 0
        for b in t:
            if b not in child[at]:
                child[at][b] = len(child)
                child.append({})
                found.append([])
            at = child[at][b]
        if at:
            found[at].append(i)
    step = np.zeros((len(child), len(used) + 1), np.int32)
    fail = [0] * len(child)
    queue = deque([0])
    while queue:  # breadth first: the state that a miss falls back to is complete before those that use it
        s = queue.popleft()
        if s:
            step[s] = step[fail[s]]
            found[s] += found[fail[s]]
        for b, t in child[s].items():
            fail[t] = int(step[s, classes[b]]) if s else 0
            step[s, classes[b]] = t
            queue.append(t)
    sizes = [len(x) for x in found]
    return Automaton(list(terms), classes, step, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([i for x in found for i in x], np.int64))


def matches(auto: Automaton, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each whole occurrence in the rows' bytes, which are in small letters.

    Rows are cut into spans that all step through the machine together; each starts early enough for the longest term, so a
    long url costs no more steps than a short one."""
    n = np.diff(bounds)
    per = -(-n // SPAN)
    row = np.repeat(np.arange(len(n)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    since = bounds[row] + number * SPAN
    pos, stop = np.maximum(since - auto.longest + 1, bounds[row]), np.minimum(since + SPAN, bounds[row + 1])
    state = np.zeros(len(row), np.int64)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    length = np.array([len(t) for t in auto.terms] or [0], np.int64)
    counts = np.diff(auto.bounds)
    rows, terms = [], []
    while len(pos):
        state = auto.step[state, auto.classes[data[pos]]].astype(np.int64)
        hit = np.flatnonzero((counts[state] > 0) & (pos >= since))
        if len(hit):
            many = counts[state[hit]]
            of = np.repeat(hit, many)
            term = auto.ends[np.repeat(auto.bounds[state[hit]], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
            first, last, r = pos[of] - length[term] + 1, pos[of], row[of]
            free = (first == bounds[r]) | ~letter[np.maximum(first - 1, 0)]
            free &= (last + 1 == bounds[r + 1]) | ~letter[np.minimum(last + 1, len(data) - 1)]
            rows.append(r[free])
            terms.append(term[free])
        pos = pos + 1
        on = pos < stop
        if not on.all():
            pos, stop, since, state, row = pos[on], stop[on], since[on], state[on], row[on]
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(terms or [none])


def _fitting(host: str, by_host: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str]]:
    """(path, rule, action) of the rules of a host and of the hosts above it, longest first; of equals, those that block."""
    found, at = [], 0
    while True:
        above = host[at:]
        found += [(path, above + path, action) for path, action in by_host.get(above, ())]
        at = host.find(".", at) + 1
        if not at:
            return sorted(found, key=lambda x: (-len(x[1]), x[2] != "block", x[1]))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, several: int = 2) -> DataFrame:
    """key, host, path, rule, verdict, strict_terms, soft_terms (sorted, distinct) of each row; one pass without a shuffle.

    rules are held by every task; for a table of rules see by_rule_table. The longest rule (host and path) that fits decides;
    of two that differ in their action alone, block does. Without one: block for a strict or `several` distinct soft terms."""
    if key.lower() in ("host", "path", "rule", "verdict", "strict_terms", "soft_terms"):
        raise ValueError("the key's name is that of a result column")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for action, host, path in rules:
        by_host.setdefault(host.lower(), []).append((path, action))
    by_host.pop("", None)
    words = sorted(set(strict) | set(soft))
    hard = np.array([w in set(strict) for w in words] or [False])
    auto = automaton([w.encode() for w in words])
    names = np.array(words or [""], object)

    def listed(row: np.ndarray, term: np.ndarray, n: int) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(names[term], pa.string()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, str, str]]] = {}
        for b in batches:
            for lo, hi, data, bounds in C.blocks(b.column("_place")):
                part, n = b.slice(lo, hi - lo), hi - lo
                row, term = matches(auto, C._LOWER[data], bounds)
                one = np.unique(row * len(names) + term)
                row, term = one // len(names), one % len(names)
                a, z = hard[term], ~hard[term]
                bad = (np.bincount(row[a], minlength=n) > 0) | (np.bincount(row[z], minlength=n) >= several)
                rule, verdict = [], []
                for host, path, no in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), bad.tolist(), strict=True):
                    if host not in known:
                        known = known if len(known) < 100_000 else {}
                        known[host] = _fitting(host, by_host)
                    hit = next((x for x in known[host] if path.startswith(x[0])), None)
                    rule.append(hit and hit[1])
                    verdict.append(hit[2] if hit else "block" if no else "allow")
                cols = [part.column(key), part.column("host"), part.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), listed(row[a], term[a], n), listed(row[z], term[z], n)]
                yield pa.RecordBatch.from_arrays(cols, [key, "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    host, path = host_and_path(pages[url])
    read = pages.select(pages[key].alias(key), host.alias("host"), path.alias("path")).withColumn("_place", F.concat("host", "path").cast("binary"))
    kind = read.schema[key].dataType.simpleString()
    return read.mapInArrow(rows, f"`{key}` {kind}, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>")


def by_rule_table(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, rule, action of each row under a table of rules (action, host, path) of any size; null where none fits.

    A url's host gives one candidate for each host above it, its path one for each length that a rule's path has: they meet the
    rules on equal host and path, so neither a host with many rules nor one with many pages multiplies out. The places of the
    pages are made distinct first. Rules with a null, or without a host, are left out; the longest wins, then block."""
    r = rules.where("action is not null and host is not null and host <> '' and path is not null").groupBy(F.translate("host", _UPPER, _LOWER).alias("_h"), F.col("path").alias("_p")).agg(F.max(F.struct((F.col("action") == "block").alias("b"), "action"))["action"].alias("_a"))
    sizes = r.agg(F.max(F.size(F.split("_h", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("_p"))).alias("lengths")).first()  # as many as paths have lengths
    host, path = host_and_path(pages[url])
    own = pages.select(pages[key].alias(key), host.alias("_host"), path.alias("_path"))
    if not sizes["labels"]:
        return own.select(key, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    above = F.array(*(F.substring_index("_host", ".", -i) for i in range(1, sizes["labels"] + 1)))
    places = own.select("_host", "_path").distinct()
    each = places.withColumn("_h", F.explode(F.array_distinct(above))).withColumn("_n", F.explode(F.array(*(F.lit(n) for n in sizes["lengths"]))))
    each = each.where(F.col("_n") <= F.length("_path")).withColumn("_p", F.expr("substring(_path, 1, _n)"))
    best = each.join(r, ["_h", "_p"]).groupBy("_host", "_path").agg(F.max(F.struct((F.length("_h") + F.length("_p")).alias("n"), (F.col("_a") == "block").alias("b"), F.concat("_h", "_p").alias("rule"), F.col("_a").alias("action"))).alias("_b"))
    return own.join(best, ["_host", "_path"], "left").select(key, F.col("_b.rule").alias("rule"), F.col("_b.action").alias("action"))


def oracle(rules: Sequence[Rule], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, several: int = 2) -> str:
    """DuckDB's SQL for key, host, path, rule and verdict over pages: a pattern for each term in place of the machine."""
    edge = "[^a-z\\x{80}-\\x{10FFFF}]"
    found = lambda t: f"CAST(regexp_matches(place, '(?:^|{edge}){t}(?:$|{edge})') AS INT)"
    fits = "".join(f" UNION ALL SELECT '{a}' AS action, '{h}' AS rhost, '{p}' AS rpath" for a, h, p in rules)[11:]
    return f"""WITH u AS (SELECT rowid_ AS id, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM (SELECT *, row_number() OVER () AS rowid_ FROM pages)),
h AS (SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, translate(host || path, '{_UPPER}', '{_LOWER}') AS place FROM h), r AS ({fits}),
m AS (SELECT id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id),
v AS (SELECT id, {" + ".join(map(found, strict))} AS hard, {" + ".join(map(found, soft))} AS mild FROM p)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hard > 0 OR mild >= {several} THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN v USING (id) LEFT JOIN m USING (id)"""
