"""URL filtering by pattern rules behind a rarest-token index.

Every rule becomes one regular expression over ``host + path``.  A rule is filed
under the rarest literal token that each URL it can match must contain; the
tokens of a URL fetch candidate rules, and only those are run.  Token counts are
taken over all URLs; what comes back to the driver is one count for each token
that occurs in a rule.

Site rules (``host/path`` with allow or block) come first and the longest fitting
one decides; equally long ones are decided by the longer host, then by block.
URLs without a site rule are judged by patterns: any that matches blocks.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty
path, which no site rule fits, and is allowed unless a pattern matches the empty
string; repeated rows are judged alike; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``site`` rules carry the text ``host/path``; patterns carry an expression and
    the literal tokens that a match must contain whole."""

    verdict: str
    text: str
    site: bool = True
    tokens: tuple[str, ...] = ()

    def expression(self) -> str:
        return r"(?:[^/]*\.)?" + re.escape(self.text) if self.site else self.text

    def literals(self) -> tuple[str, ...]:
        if not self.site:
            return self.tokens
        found = list(_TOKEN.finditer(self.text.translate(_LOWER)))
        # a last token that the rule leaves open may go on in the URL
        return tuple(m.group() for m in found if m.end() < len(self.text))

    def order(self) -> tuple[int, int, bool]:
        return len(self.text), self.text.find("/"), self.verdict == "block"


def site_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines such as ``block example.com/en/``."""
    out = []
    for line in lines:
        verdict, text = line.split()
        if verdict not in ("allow", "block") or "/" not in text:
            raise ValueError(f"not a site rule: {line!r}")
        out.append(Rule(verdict, text))
    return out


def word_pattern(words: str) -> Rule:
    """Blocks URLs that hold ``words`` (joined by - . _ or /) as whole words."""
    parts = tuple(words.split())
    return Rule("block", r".*(?<![a-z0-9])" + r"[-._/]".join(map(re.escape, parts)) + r"(?![a-z0-9])", False, parts)


#: The rules of the production query.
SITE_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]
#: Words of hosts and paths that mark junk.
JUNK_WORDS = ["spam farm", "cheap pills", "casino", "viagra", "porn", "xxx", "free money", "link farm", "adult", "betting"]


def default_rules() -> list[Rule]:
    return site_rules(SITE_RULES) + [word_pattern(w) for w in JUNK_WORDS]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[at:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:at].translate(_LOWER), path[:end]


def _count(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for b in batches:
        for url in b.column(0).to_pylist():
            host, path = split_url(url)
            seen.update(wanted.intersection(_TOKEN.findall((host + path).translate(_LOWER))))
    yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs, over all URLs."""
    wanted = frozenset(t for r in rules for t in r.literals())
    rows = urls.mapInArrow(partial(_count, wanted=wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in wanted} | {r["token"]: r["n"] for r in rows}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token to the rules filed under it, and the rules that no token can fetch."""
    index: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if literals := r.literals():
            index.setdefault(min(literals, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge(url: str | None, rules: list[Rule], compiled: list, index: dict[str, list[int]], always: list[int]) -> tuple[str, str, str | None, str, str | None]:
    """Host, path, site rule, verdict and matching pattern of one URL."""
    host, path = split_url(url)
    whole = host + path
    lowered = whole.translate(_LOWER)
    picked = {i for t in set(_TOKEN.findall(lowered)) for i in index.get(t, ())}
    best = pattern = None
    for i in sorted(picked.union(always)):
        r = rules[i]
        if r.site:
            if (best is None or r.order() > best.order()) and compiled[i].match(whole):
                best = r
        elif pattern is None and compiled[i].match(lowered):
            pattern = r
    verdict = best.verdict if best else pattern.verdict if pattern else "allow"
    return host, path, best.text if best else None, verdict, pattern.text if pattern else None


_OUT = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch], rules: list[Rule], index: dict, always: list[int]) -> Iterator[pa.RecordBatch]:
    compiled = [re.compile(r.expression(), re.DOTALL) for r in rules]
    for b in batches:
        rows = [judge(u, rules, compiled, index, always) for u in b.column(1).to_pylist()]
        columns = list(zip(*rows)) if rows else [[]] * len(_OUT)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, _OUT))], names=[b.schema.names[0], *_OUT.names])


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: id, host, path, rule (site rule that decided, or null), verdict, pattern."""
    tune(pages.sparkSession)
    rules = default_rules() if rules is None else rules
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("_url"))
    index, always = build_index(rules, token_counts(rows.select("_url"), rules))
    return rows.mapInArrow(partial(_apply, rules=rules, index=index, always=always), f"{id_col} long, host string, path string, rule string, verdict string, pattern string")
