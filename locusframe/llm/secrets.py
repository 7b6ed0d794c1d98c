"""Secret scans with multipart credential linking (operator 10).

DataFrame functions only.  Strong spans are found by pattern alone.  Weak
parts - bare keys, user names, endpoints - are candidates that are reported
only when complementary parts co-occur in their scope: parts are intervals,
and each candidate is joined with the parts whose starts lie at most ``scope``
code points away.  The join is an equi-join on (text, cell of ``scope`` code
points) of the candidate's cell and its neighbours with the least and the
greatest start of each role in a cell, which decides the interval condition
exactly without making pairs of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import dealt, hot_keys, materialize, repeated

SCOPE = 256

#: kind: (pattern, group whose length counts, least length). A match that is too short is dropped, but has consumed its text.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    # for these two a shorter match can hide no longer one, so the least length stands in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "user": (r"""(?<![A-Za-z0-9_])(?i:user|username|user_name|login|client_id|account_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 1, 3),
    "endpoint": (r"""(?<![A-Za-z0-9])(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+|s3)://[A-Za-z0-9_.:@/-]+""", 0, 8),
}
KINDS = (*BASE, *WEAK)
#: The roles that must co-occur with a weak part for it to be reported.
NEEDS = {"key": ("id",), "user": ("secret", "endpoint"), "endpoint": ("id", "secret")}
ROLES = {"id": ("access", "user"), "secret": ("assign", "hex", "key"), "endpoint": ("endpoint",)}


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Code-point spans (start, end exclusive) of the leftmost non-overlapping matches that are long enough."""
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = matches if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), sizes, lambda s, k: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(k).alias("counts")))
    empty = F.array().cast("array<struct<start:int,end:int,counts:int>>")
    walked = F.aggregate(
        F.filter(steps, lambda s: s["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.concat(acc["found"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end"), s["counts"].alias("counts")))).alias("found"),
        ),
    )["found"]
    kept = F.transform(F.filter(walked, lambda x: x["counts"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def ranked(found: Column, rank: int) -> Column:
    """Spans with their kind's place in ``KINDS``, as (start, rank, end)."""

    def tag(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))

    return F.transform(found, tag)


def found_parts(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: key, a key of the text, and for each kind the array of its spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    cols = [spans(t, *rule).alias(kind) for kind, rule in (BASE | WEAK).items()]
    return docs.select(F.col(key).alias("__key"), F.md5(t).alias("__text"), *cols, *carry)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans whose complementary parts co-occur, by text: __text, weak (array of start, rank, end)."""
    some = parts.where(F.size("key") + F.size("user") + F.size("endpoint") > 0).select("__text", *KINDS)
    tagged = F.concat(*[ranked(F.col(k), i) for i, k in enumerate(KINDS)])
    # texts repeat: their parts are distinct before anything is joined
    rows = some.select("__text", F.explode(tagged).alias("p")).select("__text", "p.*").distinct()
    rows = materialize(rows.withColumn("cell", F.floor(F.col("start") / scope).cast("int")), "parts")
    rank = {k: i for i, k in enumerate(KINDS)}
    edges = []
    for role, kinds in ROLES.items():
        mine = F.when(F.col("rank").isin(*[rank[k] for k in kinds]), F.col("start"))
        edges += [F.min(mine).alias(f"{role}_lo"), F.max(mine).alias(f"{role}_hi")]
    cells = rows.groupBy("__text", "cell").agg(*edges)
    weak = rows.where(F.col("rank") >= len(BASE)).select("__text", "rank", "start", "end", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
    near = weak.join(cells, ["__text", "cell"])

    def within(role: str) -> Column:
        return F.coalesce((F.abs(F.col(f"{role}_lo") - F.col("start")) <= scope) | (F.abs(F.col(f"{role}_hi") - F.col("start")) <= scope), F.lit(False))

    near = near.groupBy("__text", "rank", "start", "end").agg(*[F.bool_or(within(r)).alias(r) for r in ROLES])
    rule = F.lit(False)
    for kind, roles in NEEDS.items():
        met = F.col("rank") == rank[kind]
        for r in roles:
            met = met & F.col(r)
        rule = rule | met
    return near.where(rule).groupBy("__text").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("weak"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Secrets of every whole text.

    Returns a row per row of ``docs``: ``key``, ``base`` and ``spans``, arrays
    of (start, rank, end) ordered by start and then kind (rank is the place in
    ``KINDS``; code points, end exclusive).  ``spans`` holds the base spans and
    the weak parts that are linked.  A null text counts as empty and has no
    spans; repeated rows give repeated results; no other column is read.
    """
    parts = materialize(found_parts(docs, key, text), "secrets")
    base = [ranked(F.col(k), i) for i, k in enumerate(BASE)]
    weak = materialize(linked(parts, scope), "linked")
    found = parts.select("__key", "__text", F.array_sort(F.concat(*base)).alias("base"), (F.size("key") + F.size("user") + F.size("endpoint") > 0).alias("has_weak"))
    # rows without weak parts aren't joined; those of a text that many rows share are dealt to many tasks
    some = found.where("has_weak")
    hot = hot_keys(parts.where(F.size("key") + F.size("user") + F.size("endpoint") > 0).select("__text"), "__text")
    joined = dealt(some, hot, "__text", "__key").join(repeated(weak, hot, "__text"), ["__text", "__part"], "left")
    none = F.lit(None).cast(weak.schema["weak"].dataType)
    hits = found.where("not has_weak").withColumn("weak", none).unionByName(joined.select("__key", "__text", "base", "has_weak", "weak"))
    every = F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "weak")))
    return hits.select(F.col("__key").alias(key), F.col("__text").alias("text_md5"), "base", every.alias("spans"))


def digest(col: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def count_of(col: str, kind: str) -> Column:
    return F.size(F.filter(F.col(col), lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; overlapping spans become one mark.

    Texts without weak parts need no linking and aren't shuffled; the others
    are joined with their linked parts by a key of the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_weak = F.lit(False)
    for pattern, _, _ in WEAK.values():
        has_weak = has_weak | t.rlike(pattern)
    weak_docs = docs.where(has_weak)
    weak = materialize(linked(materialize(found_parts(weak_docs, docs.columns[0], text), "secrets"), scope), "linked")
    base = [ranked(spans(t, *rule), i) for i, rule in enumerate(BASE.values())]
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def clean(rows: DataFrame, more: Column) -> DataFrame:
        every = F.array_sort(F.concat(*base, more))
        walk = F.aggregate(
            every,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"),
            ),
            lambda acc: F.concat(acc["done"], F.substr(t, acc["at"] + 1)),
        )
        any_base = F.lit(False)
        for pattern, _, _ in BASE.values():
            any_base = any_base | t.rlike(pattern)
        return rows.withColumn("__clean", F.when(any_base | (F.size(more) > 0), walk).otherwise(F.col(text)))

    joined = weak_docs.withColumn("__text_key", F.md5(t)).join(weak.withColumnRenamed("__text", "__text_key").withColumnRenamed("weak", "__weak"), "__text_key", "left")
    parts = [clean(docs.where(~has_weak), none), clean(joined, F.coalesce("__weak", none)).drop("__weak", "__text_key")]
    both = parts[0].unionByName(parts[1].select(*parts[0].columns))
    return both.withColumn(text, F.col("__clean")).drop("__clean")


def oracle(scope: int = SCOPE) -> str:
    """The registered query for DuckDB, whose patterns have no look-around: a character before a weak part is
    matched and taken off again, and bare keys are whole runs of their characters with an equals sign that may follow, judged afterwards."""

    def either(words: str) -> str:
        return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words.split())

    between = r"""["'']?\x20*[:=]\x20*["'']?"""
    patterns = {
        "assign": rf"()(?:{either('password passwd secret token api_?key')}){between}([A-Za-z0-9+/_.=-]+)",
        "access": r"()(AKIA[A-Z0-9]+)",
        "hex": r"()([0-9a-f]+)",
        "key": r"()([A-Za-z0-9+/]+)=?",
        "user": rf"(^|[^A-Za-z0-9_])(?:{either('user username user_name login client_id account_id')}){between}([A-Za-z0-9@_.-]+)",
        "endpoint": r"(^|[^A-Za-z0-9])((?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+|s3)://[A-Za-z0-9_.:@/-]+)",
    }
    least = {k: v[2] for k, v in (BASE | WEAK).items()}
    parts = []
    for rank, kind in enumerate(KINDS):
        p = patterns[kind]
        rule = f"length(g) >= {least[kind]}"
        if kind == "key":
            rule = "length(g) = 40 and length(m) = 40 and regexp_matches(g, '[0-9]') and regexp_matches(g, '[A-Z]') and regexp_matches(g, '[a-z]')"
        parts.append(f"""
  select doc_id, {rank} as rank, '{kind}' as kind, pos + length(pre) as s, pos + length(m) as e from (
    select doc_id, ms[i] as m, gs[i] as g, ps[i] as pre, cast(list_sum([length(x) for x in gaps[1 : i]]) + coalesce(list_sum([length(x) for x in ms[1 : i - 1]]), 0) as bigint) as pos
    from (select *, unnest(range(1, len(ms) + 1)) as i from (
      select doc_id, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', 2) as gs, regexp_extract_all(t, '{p}', 1) as ps from d)))
  where {rule}""")
    roles = {role: ", ".join(str(KINDS.index(k)) for k in kinds) for role, kinds in ROLES.items()}
    near = {role: f"exists (select 1 from p q where q.doc_id = p.doc_id and q.rank in ({ranks}) and abs(q.s - p.s) <= {scope})" for role, ranks in roles.items()}
    rules = " or ".join(f"(rank = {KINDS.index(kind)} and {' and '.join(near[r] for r in needs)})" for kind, needs in NEEDS.items())
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
p as ({' union all '.join(parts)}),
r as (select * from p where rank < {len(BASE)} union all select * from p where {rules}),
o as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {len(BASE)}) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from r group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join o on o.doc_id = d.doc_id
"""
