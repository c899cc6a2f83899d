"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A URL's tokens fetch the rules that wait for them, and only those run their regular expressions. How rare
a token is, is counted over all URLs first.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarrystone.llm.columns import named, others

_TOKEN = re.compile("[a-z0-9\x80-\U0010ffff]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """Fits a URL in whose path `pattern` and in whose host `host` is found; `literals` are whole tokens that any URL it fits contains (none: it is tried on all)."""

    name: str
    pattern: str
    action: str
    literals: tuple[str, ...] = ()
    host: str = ""


def domain_rule(host: str, path: str, action: str) -> Rule:
    """Fits `host` and its subdomains, where the URL's path starts with `path`; its name is both."""
    tail = _TOKEN.findall(path.translate(_LOWER))
    if tail and _TOKEN.fullmatch(path[-1:].translate(_LOWER)):
        tail.pop()  # the path's last token may go on in a URL
    literals = tuple(dict.fromkeys([*_TOKEN.findall(host), *tail]))
    return Rule(host + path, rf"\A{re.escape(path)}", action, literals, rf"(?:\A|\.){re.escape(host)}\Z")


def filter_rules(lines: str) -> list[Rule]:
    """Rules of a filter list, a line each; its text is the rule's name.

    `||name` fits from the beginning of one of a host's labels, and what follows the first `/` is for the path; a line that
    begins with `/` fits anywhere in a path. `*` is any run of characters, `^` is one that is no letter, digit, `_`, `-`, `.` or `%`, or the end, `|` at the end
    is the end. `@@` before a line allows. Lines are lower-case and fit in any case of A-Z; blank ones and those after `!` are left out.
    """
    rules = []
    for line in filter(None, map(str.strip, lines.split("\n"))):
        if line.startswith("!"):
            continue
        body, action = (line[2:], "allow") if line.startswith("@@") else (line, "block")
        if not body.startswith(("||", "/")):
            raise ValueError(f"no rule: {line}")
        host, slash, path = body.removeprefix("||").partition("/") if body.startswith("||") else ("", "/", body[1:])
        # A token counts whole only if the characters beside it are given and part it from others.
        literals = [m[0] for x in (f"\n{host}", slash + path) for m in _TOKEN.finditer(x) if m.start() and not m[0].endswith("*") and _parts(x[m.start() - 1], x[m.end() : m.end() + 1])]
        found = rf"(?:\A|\.){_expression(host)}" if host else ""
        if host and slash:
            found += r"\Z"
        rules.append(Rule(line, (r"\A" if host else "") + _expression(slash + path) if slash else "", action, tuple(dict.fromkeys(literals)), found))
    return rules


def _parts(before: str, after: str) -> bool:
    return before not in "*" and after not in ("", "*")


def _expression(text: str) -> str:
    """The regular expression of a filter's wildcards; letters fit in either case."""
    out = []
    for i, c in enumerate(text):
        if c == "*":
            out.append(".*")
        elif c == "^":
            out.append(r"(?:[^0-9A-Za-z_.%\x80-\U0010ffff-]|\Z)")
        elif c == "|" and i == len(text) - 1:
            out.append(r"\Z")
        elif c in "abcdefghijklmnopqrstuvwxyz":
            out.append(f"[{c}{c.upper()}]")
        else:
            out.append(re.escape(c))
    return "".join(out)


#: A short filter list for URLs that no other rule fits.
FILTERS = """
! hosts with a label of this name, or one that begins with it
||ads.
||ads-
||adserver.
||adult.
||bets.
||casino.
||casino-
||pills.
||poker.
||porn.
||spam.
||spam-
||tracker.
||viagra.
||xxx.
! paths
/banner/*.gif|
/popunder/
/wp-login.php^
! parts of those that are wanted
@@||ads.*/about/
"""


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; then to `?`, `#` or the end. Without `://` both are empty."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(f"{host}\n{path}".translate(_LOWER)))


class RuleIndex:
    """Rules by the rarest of their literals; `counts` says how common a token is."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            entry = (len(r.name), r.name, re.compile(r.host, re.S), re.compile(r.pattern, re.S), r.action)
            if r.literals:
                self.by[min(r.literals, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def longest(self, host: str, path: str) -> tuple[int, str, str] | None:
        """(length of name, name, action) of the rule with the longest name that fits; ties to the smaller name."""
        best = None
        for found in [self.always, *[self.by[t] for t in tokens(host, path) if t in self.by]]:
            for size, name, in_host, in_path, action in found:
                if (best is None or (-size, name) < (-best[0], best[1])) and in_host.search(host) and in_path.search(path):
                    best = (size, name, action)
        return best


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """URLs that contain each of the wanted tokens, over all rows of `urls` (url)."""
    sent = urls.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(tokens(*split_url(url)) & sent.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

    rows = urls.select("url").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")).collect()
    return {r.token: r.c for r in rows}


def judge_urls(pages: DataFrame, rules: list[Rule], patterns: list[Rule] | None = None, otherwise: str = "allow", block_rules: int = 50_000) -> DataFrame:
    """`pages` (url and any others) with host, path, rule, pattern and verdict; columns of these names are replaced.

    rule is the longest of `rules` that fits (null: none), pattern the longest of `patterns` (by default, FILTERS). The verdict
    is the rule's action, else the pattern's, else `otherwise`. Names are matched as Spark matches them. A null URL, or one without `://`, has an empty host and path. Rules
    are sent to the tasks `block_rules` at a time, and each block is one more narrow pass, so their number has no limit.
    """
    patterns = filter_rules(FILTERS) if patterns is None else patterns
    context = pages.sparkSession.sparkContext
    url = named(pages, "url")
    names = others(pages, "host", "path", "rule", "pattern", "verdict")
    out = pages.select(*[f"`{x}`" for x in names])
    # Names of our own that no column has.
    mark = "__" + "_" * max(map(len, names))
    added = ["host", "path", "rule", "pattern", "rule_action", "pattern_action"]
    schema = StructType([*out.schema.fields, *[StructField(mark + x, StringType()) for x in added]])
    out = out.select("*", *[F.lit(None).cast("string").alias(mark + x) for x in added])
    every = [("rule", r) for r in rules] + [("pattern", r) for r in patterns]
    for a in range(0, max(1, len(every)), block_rules):
        block = every[a : a + block_rules]
        counts = token_counts(pages, {t for _, r in block for t in r.literals})
        sent = context.broadcast({kind: ([r for k, r in block if k == kind], counts) for kind in ("rule", "pattern")})
        out = out.mapInArrow(_judge(sent, names.index(url)), schema)
    verdict = F.coalesce(mark + "rule_action", mark + "pattern_action", F.lit(otherwise))
    return out.select(*[f"`{x}`" for x in names], *[F.col(mark + x).alias(x) for x in added[:4]], verdict.alias("verdict"))


def _judge(sent, url_at: int):
    def run(batches):
        index = {kind: RuleIndex(*x) for kind, x in sent.value.items()}
        for batch in batches:
            kept = batch.columns[:-6]
            before = [c.to_pylist() for c in batch.columns[-6:]]
            rows = []
            for url, _, _, rule, pattern, rule_action, pattern_action in zip(batch.column(url_at).to_pylist(), *before, strict=True):
                host, path = split_url(url)
                for kind in ("rule", "pattern"):
                    found = index[kind].longest(host, path)
                    had = rule if kind == "rule" else pattern
                    if found and (had is None or (-found[0], found[1]) < (-len(had), had)):
                        if kind == "rule":
                            rule, rule_action = found[1:]
                        else:
                            pattern, pattern_action = found[1:]
                rows.append((host, path, rule, pattern, rule_action, pattern_action))
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(c), pa.string()) for c in cols]], batch.schema.names)

    return run
