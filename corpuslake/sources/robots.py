"""robots.txt as fetched: groups of rules, the longest match, delays between requests.

A file is parsed once, in the task that holds it, into the rules that hold for an agent; a page is then judged by
column expressions over its domain's rules. Domains of very many pages are dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import urls
from corpuslake.operators.skew import joined_by_key
from corpuslake.session import cut

AGENT = "corpuslake"
_LINE = re.compile(r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$")
RULES = "domain string, rules array<struct<length:int,allow:boolean,pattern:string>>, crawl_delay double"


class Group(NamedTuple):
    """The rules of one group: (allow, path) pairs in order, and its delay in seconds."""

    agents: list[str]
    rules: list[tuple[bool, str]]
    delay: float | None


def groups(text: str) -> list[Group]:
    """The groups of a file. Agents in a row share what follows; lines of other kinds, and rules before any agent, say nothing."""
    out: list[Group] = []
    fresh = False
    for line in text.removeprefix("﻿").splitlines():
        found = _LINE.match(line.split("#", 1)[0])
        if not found:
            continue
        key, value = found[1].lower(), found[2]
        if key == "user-agent":
            if fresh:
                out[-1].agents.append(value.lower())
            else:
                out.append(Group([value.lower()], [], None))
            fresh = True
        elif out and key in ("allow", "disallow"):
            fresh = False
            if value:
                out[-1].rules.append((key == "allow", value))
        elif out and key == "crawl-delay":
            fresh = False
            if re.fullmatch(r"\d+(\.\d+)?", value):
                out[-1] = out[-1]._replace(delay=float(value))
    return out


def rules_for(text: str, agent: str = AGENT) -> tuple[list[tuple[bool, str]], float | None]:
    """(rules, delay) that hold for ``agent``: those of all groups that name it most closely, else of those for "*"."""
    all_groups, token = groups(text), re.split(r"[/\s]", agent.lower())[0]
    named = [a for g in all_groups for a in g.agents if a != "*" and token.startswith(re.split(r"[/\s]", a)[0]) and a]
    best = max(named, key=len, default="*")
    chosen = [g for g in all_groups if best in g.agents]
    return [r for g in chosen for r in g.rules], next((g.delay for g in chosen if g.delay is not None), None)


def pattern_of(path: str) -> str:
    """The regular expression of a rule's path: "*" stands for anything, "$" at its end for the end."""
    end = path.endswith("$")
    body = ".*".join(re.sub(r"[^A-Za-z0-9_/]", lambda m: "\\" + m[0] if ord(m[0]) < 128 else m[0], part) for part in (path[:-1] if end else path).split("*"))
    return f"(?s)^{body}" + ("$" if end else "")


def rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """domain, rules, crawl_delay of each row of ``files`` (domain, content); a null or empty file forbids nothing. Of several files of a domain one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.struct([("length", pa.int32()), ("allow", pa.bool_()), ("pattern", pa.string())])), pa.float64())
        for batch in batches:
            found = [rules_for(t or "", agent) for t in batch.column(1).to_pylist()]
            listed = [[{"length": len(p), "allow": a, "pattern": pattern_of(p)} for a, p in rs] for rs, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, kinds[0]), pa.array([d for _, d in found], kinds[1])], ["domain", "rules", "crawl_delay"])

    first = files.where("domain is not null").groupBy(F.lower("domain").alias("domain")).agg(F.min(F.col("content").cast("string")).alias("content"))
    return first.mapInArrow(run, RULES)


def _with_rules(rows: DataFrame, known: DataFrame, url: str) -> DataFrame:
    """``rows`` with the rules and delay of their domains (null: no file)."""
    rows = rows.withColumn("__domain", urls.domain(url))
    counts = cut(rows.groupBy(F.col("__domain")).agg(F.count(F.lit(1)).alias("copies")))
    return joined_by_key(rows, known.withColumnRenamed("domain", "__domain"), counts, ["__domain"], url, "left").drop("__domain")


def allowed(rows: DataFrame, files: DataFrame, agent: str = AGENT, on_missing: bool = False, url: str = "url") -> DataFrame:
    """``rows`` that their domain's file lets ``agent`` fetch, with ``crawl_delay``: the longest matching rule decides, of equally long ones an allowing one.

    What no rule matches is allowed, as is /robots.txt itself. A domain without a file is refused, or allowed with ``on_missing``.
    A column crawl_delay of ``rows`` gives way.
    """
    out = _with_rules(rows.drop("crawl_delay"), cut(rules(files, agent)), url)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    hit = F.array_max(F.filter("rules", lambda r: F.rlike("__path", r["pattern"])))  # length first, then allow
    verdict = F.when(F.col("rules").isNull(), F.lit(on_missing)).when(F.col("__path") == "/robots.txt", True).otherwise(F.coalesce(hit["allow"], F.lit(True)))
    return out.withColumn("__path", path).where(verdict).drop("rules", "__path")
