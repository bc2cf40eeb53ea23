"""URL verdicts: host and path rules, then a tree of path templates judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tableproof.llm.joins import lookup_join
from tableproof.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TemplateTree:
    """Parameters of the template tree."""

    #: Path segments that are levels of the tree; what lies deeper is one last segment.
    depth: int = 4
    #: A branch with fewer labelled pages has too thin evidence to be told from its siblings.
    least_labelled: int = 8
    #: Chi-square (one degree of freedom) up to which a branch counts as its parent's like.
    similar: float = 3.84
    #: Labelled pages that the prior is worth in every branch.
    prior_rows: float = 8.0
    #: Branches with a smaller smoothed share of good pages are blocked.
    least_purity: float = 0.6


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule (``host/path``) that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Path with ids generalised: long runs of hexadecimal digits, then runs of digits, become ``#``, which no path holds."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9A-Fa-f]{16,}", "#"), "[0-9]+", "#")


def _levels(shape: Column, depth: int) -> list[Column]:
    """Segments as tree levels; the last one takes all that lies deeper. Absent levels are null."""
    parts = F.split(F.substring(shape, 2, 2147483647), "/")
    levels = [F.when(F.size(parts) > i, parts[i]) for i in range(depth)]
    return [*levels, F.when(F.size(parts) > depth, F.array_join(F.slice(parts, depth + 1, 1000000), "/"))]


def _chi(n: str, g: str, all_n: str, all_g: str) -> Column:
    """Chi-square of ``g`` good pages of ``n`` against the parent's share; 0 where there is nothing to tell apart."""
    share = F.col(all_g) / F.col(all_n)
    off = F.col(g) - F.col(n) * share
    chi = F.when(F.col(all_g).isin(0) | (F.col(all_g) == F.col(all_n)) | (F.col(n) == 0), 0.0).otherwise(
        off * off / (F.col(n) * share * (F.lit(1.0) - share))
    )
    return F.when(F.col(all_n) == 0, 0.0).otherwise(chi)


def _children(shapes: DataFrame, seg: Sequence[str], i: int, tree: TemplateTree, *more: Column) -> DataFrame:
    """Branches at level ``i``, and ``unlike``: enough labelled pages, and another share of good ones than their parent."""
    above = ["host", *seg[:i]]
    inner = shapes.where(F.col(seg[i - 1]).isNotNull()) if i else shapes
    branch = shapes.where(F.col(seg[i]).isNotNull()).groupBy(*above, seg[i]).agg(F.sum("n").alias("bn"), F.sum("g").alias("bg"), *more)
    parent = inner.groupBy(*above).agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
    unlike = (F.col("bn") >= tree.least_labelled) & (_chi("bn", "bg", "pn", "pg") > tree.similar)
    return branch.join(parent, above).withColumn("unlike", unlike)


def template_verdicts(pages: DataFrame, tree: TemplateTree) -> DataFrame:
    """One row per (host, shape) of ``pages`` (host, shape, good: 1, 0 or null): template, verdict, n_pages.

    Everything after the first grouping works on distinct shapes, never on pages, so a host with a
    third of all pages is a few rows. First every branch is tested against its parent. Then, level by
    level, segments become a wildcard unless their branch, among those generalised so far, differs from
    its parent, or a branch below them does; neither the number of siblings nor a branch's size counts.
    Last, from the leaves up, a branch whose share of good pages does not differ
    from its parent's is merged into the parent. The template left is judged by its share of
    good labelled pages, smoothed towards the share among all labelled pages.
    """
    seg = [f"s{i}" for i in range(tree.depth + 1)]
    shapes = pages.groupBy("host", "shape").agg(
        F.count("*").alias("n_pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")
    )
    shapes = shapes.select("*", *[c.alias(s) for c, s in zip(_levels(F.col("shape"), tree.depth), seg)])
    shapes = materialize(shapes, "shapes")
    marked = shapes
    for i in range(len(seg)):
        unlike = _children(shapes, seg, i, tree).where("unlike").select("host", *seg[: i + 1], F.lit(i).alias(f"__d{i}"))
        marked = marked.join(unlike, ["host", *seg[: i + 1]], "left")
    deepest = F.greatest(*[F.coalesce(f"__d{i}", F.lit(-1)) for i in range(len(seg))])
    shapes = materialize(marked.select(*shapes.columns, deepest.alias("deepest")), "marked")
    for i, s in enumerate(seg):
        children = _children(shapes, seg, i, tree, F.max("deepest").alias("below"))
        stay = children.where(F.col("unlike") | (F.col("below") >= i)).select("host", *seg[: i + 1], F.lit(True).alias("__stay"))
        held = shapes.join(stay, ["host", *seg[: i + 1]], "left")
        kept = F.when(F.col(s).isNotNull() & F.col("__stay").isNull(), "*").otherwise(F.col(s))
        # Written per level: each level reads the table several times, and plans would multiply.
        shapes = materialize(held.select(*[c for c in shapes.columns if c != s], kept.alias(s)), "generalised")
    for i in range(len(seg) - 1, -1, -1):
        s, above = seg[i], ["host", *seg[:i]]
        deeper = seg[i + 1:]
        leaf = F.col(s).isNotNull()
        for d in deeper:
            leaf = leaf & F.col(d).isNull()
        branch = shapes.where(leaf).groupBy(*above, s).agg(F.sum("n").alias("bn"), F.sum("g").alias("bg"))
        parent = shapes.groupBy(*above).agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"))
        joined = branch.alias("b").join(parent.alias("p"), [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in above])
        like = joined.withColumn("chi", _chi("bn", "bg", "pn", "pg")).where(F.col("chi") <= tree.similar)
        like = like.select(*[F.col(f"b.{k}") for k in [*above, s]], F.lit(True).alias("__like"))
        hit = shapes.alias("a").join(
            like.alias("r"), [F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*above, s]], "left"
        )
        gone = F.col("r.__like").isNotNull() & leaf_of("a", s, deeper)
        merged = hit.select(
            *[F.col(f"a.{c}") for c in shapes.columns if c != s], F.when(~gone, F.col(f"a.{s}")).alias(s)
        )
        shapes = materialize(merged, "merged")
    template = F.concat(F.col("host"), F.concat_ws("/", F.lit(""), *seg))
    total = shapes.agg(F.sum("n").alias("n"), F.sum("g").alias("g")).first()
    prior = (total["g"] / total["n"]) if total["n"] else 1.0
    shapes = shapes.withColumn("template", template)
    purity = (F.sum("g") + F.lit(tree.prior_rows) * prior) / (F.sum("n") + F.lit(tree.prior_rows))
    judged = shapes.groupBy("template").agg(purity.alias("purity"))
    return shapes.join(judged, "template").select(
        "host", "shape", "n_pages", "template",
        F.when(F.col("purity") < tree.least_purity, "block").otherwise("allow").alias("says"),
    )


def leaf_of(side: str, s: str, deeper: Sequence[str]) -> Column:
    """Whether a row's path ends at level ``s``."""
    leaf = F.col(f"{side}.{s}").isNotNull()
    for d in deeper:
        leaf = leaf & F.col(f"{side}.{d}").isNull()
    return leaf


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], tree: TemplateTree = TemplateTree()
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template.

    ``labels`` has page_id and good (1, 0 or null); several labels of a page count as their
    minimum. A rule's verdict overrides the template's. Null urls and urls without ``://`` have an
    empty host and path and share one template. Without labels every template is allowed.
    """
    known = labels.groupBy("page_id").agg(F.min("good").alias("good"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("path")))
    says = materialize(template_verdicts(rows.join(known, "page_id", "left"), tree), "template-verdicts")
    total = says.agg(F.sum("n_pages")).first()[0] or 0
    joined = lookup_join(rows, says, ["host", "shape"], "n_pages", total)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return joined.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("says")).alias("verdict"), "template"
    )


# --- the same in SQL ----------------------------------------------------------

def judge_urls_sql(rules: Sequence[tuple[str, str]], tree: TemplateTree = TemplateTree()) -> str:
    """DuckDB SQL over ``pages`` and ``labels`` that gives the rows of the registered query."""
    seg = [f"s{i}" for i in range(tree.depth + 1)]
    same = lambda a, b, ks: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in ks)
    cte = [
        "lab AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id)",
        r"""cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)""",
        rf"""raw AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)""",
        "shaped AS (SELECT *, regexp_replace(regexp_replace(path, '[0-9A-Fa-f]{16,}', '#', 'g'), '[0-9]+', '#', 'g') AS shape FROM raw)",
        """grouped AS (SELECT host, shape, count(*) AS n_pages, count(good) AS n, coalesce(sum(good), 0) AS g,
            string_split(substr(shape, 2), '/') AS parts FROM shaped LEFT JOIN lab USING (page_id) GROUP BY host, shape)""",
    ]
    cols = ", ".join(
        [f"CASE WHEN len(parts) > {i} THEN parts[{i + 1}] END AS s{i}" for i in range(tree.depth)]
        + [f"CASE WHEN len(parts) > {tree.depth} THEN array_to_string(parts[{tree.depth + 1}:], '/') END AS s{tree.depth}"]
    )
    cte.append(f"t0 AS (SELECT host, shape, n_pages, n, g, {cols} FROM grouped)")
    chi = """CASE WHEN pn = 0 OR pg = 0 OR pg = pn OR bn = 0 THEN 0.0
        ELSE (bg - bn * (pg / pn)) * (bg - bn * (pg / pn)) / (bn * (pg / pn) * (1.0::DOUBLE - pg / pn)) END"""

    def children(t: str, i: int, more: str = "") -> list[str]:
        ks, inner = ", ".join(["host", *seg[:i]]), f"WHERE {seg[i - 1]} IS NOT NULL" if i else ""
        return [
            f"b_{t}_{i} AS (SELECT {ks}, {seg[i]}, sum(n)::DOUBLE AS bn, sum(g)::DOUBLE AS bg{more} FROM {t} WHERE {seg[i]} IS NOT NULL GROUP BY {ks}, {seg[i]})",
            f"p_{t}_{i} AS (SELECT {ks}, sum(n)::DOUBLE AS pn, sum(g)::DOUBLE AS pg FROM {t} {inner} GROUP BY {ks})",
            f"c_{t}_{i} AS (SELECT *, bn >= {tree.least_labelled} AND {chi} > {tree.similar}::DOUBLE AS unlike FROM b_{t}_{i} JOIN p_{t}_{i} USING ({ks}))",
        ]

    for i in range(len(seg)):
        cte += children("t0", i)
    ups = [", ".join(["host", *seg[: i + 1]]) for i in range(len(seg))]
    cte.append(
        "d0 AS (SELECT t0.*, greatest(" + ", ".join(f"CASE WHEN u{i}.d IS NULL THEN -1 ELSE {i} END" for i in range(len(seg))) + ") AS deepest FROM t0 "
        + " ".join(f"LEFT JOIN (SELECT {u}, 1 AS d FROM c_t0_{i} WHERE unlike) u{i} ON {' AND '.join(f't0.{k} = u{i}.{k}' for k in u.split(', '))}" for i, u in enumerate(ups))
        + ")"
    )
    for i, s in enumerate(seg):
        t = f"d{i}"
        cte += [
            *children(t, i, ", max(deepest) AS below"),
            f"d{i + 1} AS (SELECT {t}.* REPLACE (CASE WHEN {t}.{s} IS NOT NULL AND k.d IS NULL THEN '*' ELSE {t}.{s} END AS {s}) FROM {t} LEFT JOIN "
            f"(SELECT {ups[i]}, 1 AS d FROM c_{t}_{i} WHERE unlike OR below >= {i}) k ON " + " AND ".join(f"{t}.{c} = k.{c}" for c in ["host", *seg[: i + 1]]) + ")",
        ]
    prev = f"d{len(seg)}"
    for i in range(len(seg) - 1, -1, -1):
        s, above = seg[i], ["host", *seg[:i]]
        ks = ", ".join(above)
        leaf = lambda t: " AND ".join([f"{t}.{s} IS NOT NULL", *[f"{t}.{d} IS NULL" for d in seg[i + 1:]]])  # noqa: B023, E731
        cte += [
            f"br{i} AS (SELECT {ks}, {s}, sum(n)::DOUBLE AS bn, sum(g)::DOUBLE AS bg FROM {prev} WHERE {leaf(prev)} GROUP BY ALL)",
            f"pa{i} AS (SELECT {ks}, sum(n)::DOUBLE AS pn, sum(g)::DOUBLE AS pg FROM {prev} GROUP BY ALL)",
            f"""li{i} AS (SELECT br{i}.* FROM br{i} JOIN pa{i} ON {same(f'br{i}', f'pa{i}', above)}
                WHERE {chi} <= {tree.similar}::DOUBLE)""",
            f"m{i} AS (SELECT {prev}.* REPLACE (CASE WHEN l.bn IS NOT NULL AND {leaf(prev)} THEN NULL ELSE {prev}.{s} END AS {s}) FROM {prev} LEFT JOIN li{i} l ON {same(prev, 'l', [*above, s])})",
        ]
        prev = f"m{i}"
    fitted = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda t: (
        f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    )
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in fitted) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for t, v in fitted) + " ELSE says END"
    cte += [
        f"named AS (SELECT *, host || concat_ws('/', '', {', '.join(seg)}) AS template FROM {prev})",
        "prior AS (SELECT CASE WHEN sum(n) > 0 THEN sum(g)::DOUBLE / sum(n)::DOUBLE ELSE 1.0 END AS p FROM named)",
        f"""judged AS (SELECT template, CASE WHEN (sum(g)::DOUBLE + {tree.prior_rows}::DOUBLE * any_value(p)) / (sum(n)::DOUBLE + {tree.prior_rows}::DOUBLE)
            < {tree.least_purity}::DOUBLE THEN 'block' ELSE 'allow' END AS says FROM named, prior GROUP BY template)""",
    ]
    return (
        "WITH " + ",\n".join(cte)
        + f"\nSELECT page_id, host, path, {rule} AS rule, {says} AS verdict, template"
        + "\nFROM shaped JOIN (SELECT host, shape, template, says FROM named JOIN judged USING (template)) USING (host, shape)"
    )
