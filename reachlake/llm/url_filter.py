"""URL filters: allow and block rules by host and path, the longest fitting rule decides.

The rules form a trie over reversed host labels and then path segments. A trie of bounded size goes
to every task; larger rule sets are matched by a join on (host suffix, path up to a segment).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.textvec import kept_columns

# Rules that are sent to every task; some hundred bytes each, so below about 64 MB.
MAX_BROADCAST_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[tuple[str, str]]) -> list[Rule]:
    """``(verdict, "host/path")`` pairs; hosts are lower-cased (A-Z)."""
    out = []
    for verdict, text in lines:
        host, slash, path = text.partition("/")
        out.append(Rule(verdict, ascii_lower(host), slash + path))
    return out


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class UrlTrie:
    """Nodes are dicts from host label to node; a node's path part is a second trie of segments.

    A rule's last path segment is a prefix of the url's segment there, all earlier ones are equal to
    the url's. Under a path node, ``ends`` maps such a prefix to the rule's ``(text, verdict)``.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {"next": {}, "paths": None}
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            at = node["paths"] = node["paths"] or {"next": {}, "ends": {}}
            *whole, tail = r.path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
            old = at["ends"].get(tail)
            # Of equal rules the block entry counts.
            if old is None or r.verdict == "block":
                at["ends"][tail] = (r.text, r.verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule: longest host first reached wins by total length, block on a tie."""
        best: tuple[int, int, str, str] | None = None
        node, segments = self.root, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is None:
                continue
            segments = segments if segments is not None else path.split("/")
            at = node["paths"]
            for segment in segments:
                for tail, (text, verdict) in at["ends"].items() if len(at["ends"]) < 8 else _tails(at, segment):
                    if segment.startswith(tail):
                        found = (len(text), verdict == "block", text, verdict)
                        best = found if best is None or found > best else best
                at = at["next"].get(segment)
                if at is None:
                    break
        return (best[2], best[3]) if best else (None, None)


def _tails(at: dict, segment: str):
    """The entries among many whose key starts ``segment``."""
    sizes = at.setdefault("sizes", sorted({len(t) for t in at["ends"]}))
    for n in sizes:
        if n <= len(segment) and (hit := at["ends"].get(segment[:n])):
            yield segment[:n], hit


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and every subdomain if the path starts with the rule's path. The longest
    rule wins, a block entry wins among equals. Urls that no rule fits get ``default`` and a null
    rule. A null url or one without ``://`` has an empty host and path. A url without a path doesn't
    start with ``/``, so it fits only rules without a path. Repeated rows are judged each; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = kept_columns(pages, {"id": id_col, "url": url_col}).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= max_broadcast_rules:
        out = _by_trie(rows, rules)
    else:
        out = _by_join(rows, rules)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule",
                      F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _by_trie(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    schema = f"{rows.select('id').schema['id'].simpleString().replace('id:', 'id ', 1)}, host string, path string, rule string, verdict string"

    def run(stream):
        trie = shared.value
        for b in stream:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            found = [trie.match(h, p) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("path"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.string())], ["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def _by_join(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same answers through a join of each url's host suffixes and path cuts with the rules."""
    spark = rows.sparkSession
    parts = [(r.host, r.path.rpartition("/")[0] + r.path.rpartition("/")[1], r.path.rpartition("/")[2], r.text, r.verdict)
             for r in rules]
    table = spark.createDataFrame(parts, "host string, cut string, tail string, rule string, verdict string")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    n, m = F.size(labels), F.size(segments)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    cuts = F.transform(F.sequence(F.lit(0), m - 1),
                       lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))))
    # One row per different (host, path): a busy host's copies don't meet the join.
    seen = rows.select("host", "path").distinct()
    want = seen.select("host", "path", F.explode(suffixes).alias("h"), cuts.alias("cuts")).select(
        "host", "path", "h", F.explode("cuts").alias("cut"))
    hit = want.join(table.withColumnRenamed("host", "h"), ["h", "cut"]).where(
        F.col("path").startswith(F.concat("cut", "tail")))
    rank = F.struct(F.length("rule"), (F.col("verdict") == "block").cast("int"), F.col("rule"))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("r"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", "r.rule", "r.verdict")


# The rules of the registered query.
RULES = parse_rules([("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
SQL = f"""
with rules(verdict, host, path) as (values {', '.join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
u as (select row_number() over () as n, page_id, {_HOST} as host, {_PATH} as path from pages),
hit as (
  select u.n, arg_max(r.host || r.path, length(r.host || r.path) * 2 + (r.verdict = 'block')::int) as rule,
         arg_max(r.verdict, length(r.host || r.path) * 2 + (r.verdict = 'block')::int) as verdict
  from u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
  group by u.n)
select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, 'allow') as verdict
from u left join hit using (n)
"""
