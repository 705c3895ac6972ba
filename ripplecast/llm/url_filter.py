"""URL filter: pattern rules looked up by their rarest literal token.

A pattern is literal text in which ``*`` is anything, ``^`` a separator or the end, a leading ``||`` the start of the host
or of one of its labels, and ``|`` at either end that end of the address.  Patterns are matched against the whole address,
scheme, query and fragment included, with A-Z lower-cased on both sides.  Strong rules are a host and the head of a path:
they see host and path alone, and the case of a path counts.  Every rule is stored under one of its literal
tokens, the one that the fewest addresses hold; the tokens of an address fetch the few rules whose regular expression is
then run.  Rules without a literal token are run on every address.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, extended

TOKEN = r"[a-z0-9\u0080-￿]+"
BLOCK_OF_RULES = 200_000  # rules sent along at once (some 50 MB); more are applied block by block

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    """``strong`` rules go before the others; among equals the longest pattern wins, then the first by name."""

    name: str
    pattern: str
    verdict: str
    strong: bool = False

    @property
    def order(self) -> tuple:
        return (not self.strong, -len(self.name), self.name, self.pattern, self.verdict)

    @property
    def regex(self) -> str:
        body, head, tail = self.pattern if self.strong else self.pattern.translate(FOLD), "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^(?:[^/]*\.)?" if self.strong else r"^(?s:(?!://).)*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], "^"
        if body.endswith("|"):
            body, tail = body[:-1], r"\Z"
        parts = {"*": r"(?s:.*)", "^": r"(?:[^a-zA-Z0-9_.%-]|\Z)"}
        return head + "".join(parts.get(c) or re.escape(c) for c in body) + tail

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every matching address holds as whole tokens."""
        body = self.pattern.translate(FOLD)
        start = body.startswith("|")
        body = body.removeprefix("||").removeprefix("|")
        found = set()
        for m in re.finditer(TOKEN, body):
            left = start if m.start() == 0 else body[m.start() - 1] != "*"
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.add(m.group())
        return sorted(found)


def host_rule(text: str, verdict: str) -> Rule:
    """``example.net/en/``: a host with its subdomains and a path prefix."""
    return Rule(text, "||" + text, verdict, strong=True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host after the first ``://`` and path behind it; both empty without ``://`` and for null."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(text, r"://([^/?#]*)", 1)), F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def rarest_tokens(addresses: DataFrame, column: str, rules: list[Rule]) -> dict[Rule, str | None]:
    """For every rule the literal token that the fewest addresses hold (ties: the longest, then the first)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held: dict[str, int] = {}
    if wanted:
        spark = addresses.sparkSession
        tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(column)), F.lit(f"({TOKEN})"), F.lit(1)))
        listed = spark.createDataFrame([(t,) for t in wanted], "token string")
        counted = addresses.select(F.explode(tokens).alias("token")).groupBy("token").count().join(listed, "token")
        held = {r["token"]: r["count"] for r in counted.collect()}  # at most one row per rule token
    return {r: min(r.tokens, key=lambda t: (held.get(t, 0), -len(t), t), default=None) for r in rules}


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``pattern`` and ``verdict``.

    ``rule`` names the strong rule that decided, ``pattern`` the other rule that decided when no strong one fits; both are
    null when the ``default`` holds.  A null address is an empty one, with an empty host and path.
    Every row is judged alone, so repeated rows get the same verdict; kept columns of the new names are replaced.
    """
    new = ["host", "path", "rule", "pattern", "verdict"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    host, path = host_and_path(url)
    address = F.coalesce(df[f"`{url}`"].cast("string"), F.lit(""))
    rows = df.select(address.alias("_address"), host.alias("host"), path.alias("path"), *[df[f"`{c}`"] for c in kept])
    at = rarest_tokens(rows, "_address", rules)
    sent = rows.sparkSession.sparkContext.broadcast
    ordered = sorted(set(rules), key=lambda r: r.order)
    parts = [sent([(r, at[r]) for r in ordered[i : i + BLOCK_OF_RULES]]) for i in range(0, len(ordered), BLOCK_OF_RULES)]
    schema = extended(rows.drop("_address").schema, "rule string, pattern string, verdict string")

    def indexed(block) -> dict[str | None, list]:
        index = defaultdict(list)
        for rank, (rule, token) in enumerate(block):
            index[token].append((rank, re.compile(rule.regex).search, rule))
        return index

    def run(batches):
        split = re.compile(TOKEN).findall
        indexes: list = [indexed(p.value) for p in parts] if len(parts) == 1 else []
        for batch in batches:
            found: list[Rule | None] = [None] * batch.num_rows
            short = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            whole = [a.translate(FOLD) for a in batch.column(0).to_pylist()]
            for index in indexes or map(indexed, (p.value for p in parts)):  # blocks come best first
                for i, address in enumerate(whole):
                    if found[i] is None:
                        fetched = [c for t in {None, *split(address)} for c in index.get(t, ())]
                        found[i] = next((rule for _, fits, rule in sorted(fetched, key=lambda c: c[0]) if fits(short[i] if rule.strong else address)), None)
            out = [
                [r.name if r and r.strong else None for r in found],
                [r.name if r and not r.strong else None for r in found],
                [r.verdict if r else default for r in found],
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x, pa.string()) for x in out]], names=schema.names)

    return rows.mapInArrow(run, schema)


RULES = [
    host_rule("net/", "block"), host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"),
]
# The method's own patterns: unwanted hosts and sections.
PATTERNS = [Rule(p, p, "block") for p in (
    "||spam-farm.", "||ads.", "||casino.", "||adult.", "||xxx.", "||malware.", "||phishing.", "/porn/", "/casino/", "/wp-login.php^",
)]


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages").select("page_id", "url"), RULES + PATTERNS, keep=["page_id"]).select(
        "page_id", "host", "path", "rule", "verdict", "pattern")


_HOST = f"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = "regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1)"
SQL_OP10 = rf"""
with a as (select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as u, {_HOST} as host, {_PATH} as path from pages),
b as (select *, case
    when regexp_matches(host, '(^|\.)example\.net$') and starts_with(path, '/en/') then 'example.net/en/'
    when regexp_matches(host, '(^|\.)example\.com$') and starts_with(path, '/de/') then 'example.com/de/'
    when regexp_matches(host, '(^|\.)org$') and starts_with(path, '/fr/') then 'org/fr/'
    when regexp_matches(host, '(^|\.)net$') and starts_with(path, '/') then 'net/' end as rule,
  case
    when regexp_matches(u, '/wp-login\.php([^a-z0-9_.%-]|$)') then '/wp-login.php^'
    when regexp_matches(host, '(^|\.)spam-farm\.') then '||spam-farm.'
    when regexp_matches(host, '(^|\.)phishing\.') then '||phishing.'
    when regexp_matches(host, '(^|\.)malware\.') then '||malware.'
    when regexp_matches(host, '(^|\.)casino\.') then '||casino.'
    when contains(u, '/casino/') then '/casino/'
    when regexp_matches(host, '(^|\.)adult\.') then '||adult.'
    when regexp_matches(host, '(^|\.)ads\.') then '||ads.'
    when contains(u, '/porn/') then '/porn/'
    when regexp_matches(host, '(^|\.)xxx\.') then '||xxx.' end as hit
  from a)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
       when hit is not null then 'block' else 'allow' end as verdict,
  case when rule is null then hit end as pattern
from b
"""
