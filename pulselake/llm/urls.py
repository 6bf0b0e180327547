"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` (host in lower case): literal text, ``*`` for any text,
a leading ``||`` for "the host or a subdomain of it starts here", ``|`` at the end for the end.
Its tokens are the runs of ASCII letters and digits that stand whole in the pattern; the one that
is rarest over all urls indexes the rule. A url's tokens fetch candidate rules, and only those run
their regular expressions. Rules without a whole token are candidates of every url.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import columns, record_batch

#: Fixed values: (action, rule) of the host and path rules.
PATH_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: What spam hosts and paths are about, and where such a word stands in a pattern.
SPAM_TOPICS = "adult betting bingo blackjack casino cheap cialis escort escorts farma gambling giveaway gratis hentai hookup jackpot keygen keygens loan loans lottery lotto malware milf nude nudes payday pharmacy phentermine phishing pills poker porn porno replica roulette serial sexcam slots spam steroids streamrip torrents tramadol viagra viagras warez webcams xanax xxx".split()
SPAM_FORMS = ["||{0}-*", "||*-{0}.", "||*-{0}-*", "||{0}.", "||*/{0}/"]
SPAM_PATTERNS = [form.format(topic) for topic in SPAM_TOPICS for form in SPAM_FORMS]

#: Rules are sent to every task: more than this many characters of patterns are refused.
MAX_RULE_CHARS = 32 << 20

_TOKEN = re.compile(r"[0-9A-Za-z]+")


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str
    name: str | None  # reported rule; None for patterns of the method
    rank: tuple[int, int]  # the highest wins


def path_rule(action: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    return Rule(action, "||" + rule, rule, (1, len(rule)))


def pattern_rule(action: str, pattern: str) -> Rule:
    return Rule(action, pattern, None, (0, len(pattern)))


def to_regex(pattern: str) -> re.Pattern:
    body = pattern.removeprefix("||")
    end = body.endswith("|")
    body = ".*?".join(re.escape(p) for p in body.removesuffix("|").split("*"))
    head = r"(?:[^/]*\.)?" if pattern.startswith("||") else ".*?"
    return re.compile(head + body + (r"\Z" if end else ""), re.DOTALL)


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that a fitting url must have as whole tokens: bounded in the pattern by other
    literal characters or by an anchor."""
    body = pattern.removeprefix("||")
    end = body.endswith("|")
    body = body.removesuffix("|")
    out = set()
    for m in _TOKEN.finditer(body):
        left = pattern.startswith("||") if m.start() == 0 else body[m.start() - 1] != "*"
        right = end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            out.add(m[0])
    return out


def url_parts(url: str | Column = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.when(F.instr(c, "://") > 0, F.substr(c, F.instr(c, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rarest literal token (ties: the smaller string) to rules; and the rules without one."""
    index: dict[str, list[int]] = {}
    rest = []
    for i, r in enumerate(rules):
        tokens = literal_tokens(r.pattern)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            rest.append(i)
    return index, rest


class RuleIndex:
    """Rules by their rarest literal token; ``runs`` counts the regular expressions that were run."""

    def __init__(self, rules: list[Rule], counts: dict[str, int], default: str):
        self.rules, self.default, self.runs = rules, default, 0
        self.index, self.rest = index_rules(rules, counts)
        self.place = {i: k for k, i in enumerate(sorted(range(len(rules)), key=lambda i: rules[i].rank, reverse=True))}
        self.regexes: dict[int, re.Pattern] = {}

    def candidates(self, target: str) -> list[int]:
        """Rules that the tokens of a url fetch, the highest rank first."""
        found = set(self.rest)
        for t in _TOKEN.findall(target):
            if t in self.index:
                found.update(self.index[t])
        return sorted(found, key=self.place.__getitem__)

    def decide(self, target: str) -> tuple[str | None, str]:
        for i in self.candidates(target):
            if i not in self.regexes:  # most rules are never fetched
                self.regexes[i] = to_regex(self.rules[i].pattern)
            self.runs += 1
            if self.regexes[i].match(target):
                return self.rules[i].name, self.rules[i].action
        return None, self.default


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules of a table with action and pattern: patterns begin with ``|`` or ``*``, others are host and
    path rules. Rows with nulls are left out; repeated ones count once; more than ``MAX_RULE_CHARS``
    characters are refused before they are fetched."""
    rows = table.select("action", "pattern").where("action is not null and pattern is not null").distinct()
    if (rows.agg(F.sum(F.length("pattern"))).first()[0] or 0) > MAX_RULE_CHARS:
        raise ValueError("too many rules to send to every task; filter by parts of the rules")
    return [pattern_rule(a, p) if p.startswith(("|", "*")) else path_rule(a, p) for a, p in sorted(map(tuple, rows.collect()))]


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow", url: str = "url") -> DataFrame:
    """Verdict of every page's url, added as host, path, rule, verdict.

    Of the rules that fit, the highest rank wins: host and path rules before patterns, then the
    longer one. ``rule`` is a host and path rule's text, else null; where nothing fits, the verdict
    is ``default``. Token counts cover all urls. No shuffle of pages: the rules (bounded by
    ``MAX_RULE_CHARS``) go to the tasks, the urls don't move.

    Null urls and urls without ``://`` have an empty host and path, and so get the default unless a
    pattern fits the empty text; urls of any length are read whole. Rules of equal rank can't both be
    longest: of equal ones the first counts. Other columns are kept; those named host, path, rule or
    verdict, in whatever letter case, are replaced. Repeated rows each get their verdict; an empty table
    gives no rows.
    """
    rules = [path_rule(*r) for r in PATH_RULES] + [pattern_rule("block", p) for p in SPAM_PATTERNS] if rules is None else rules
    if sum(len(r.pattern) for r in rules) > MAX_RULE_CHARS:
        raise ValueError("too many rules to send to every task; filter by parts of the rules")
    host, path = url_parts(url)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    vocabulary = sorted(set().union(*(literal_tokens(r.pattern) for r in rules)))
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(r"([0-9A-Za-z]+)"), F.lit(1)))).alias("token")
    counts = {}
    if vocabulary:
        counted = parts.select(token).where(F.col("token").isin(vocabulary)).groupBy("token").count()
        counts = {r["token"]: r["count"] for r in counted.collect()}  # at most one row a rule token
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = RuleIndex(rules, counts, default)
        for batch in batches:
            hosts, paths = columns(batch, "host", "path")
            got = [found.decide(h + p) for h, p in zip(hosts, paths, strict=True)]
            schema = batch.schema.append(pa.field("rule", pa.string())).append(pa.field("verdict", pa.string()))
            yield record_batch(schema, [*batch.columns, [g[0] for g in got], [g[1] for g in got]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(judge, f"{fields}, rule string, verdict string")
