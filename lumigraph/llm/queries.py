"""The registered training-data queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigraph.llm import boruvka, clusters, leaks, mixture, neighbours, together, toxic
from lumigraph.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every face in a group of two or more linked faces."""
    return clusters.cluster(table(spark, sf_dir, "face"), "face_id", "encoding").select(F.col("id").alias("face_id"), "group_id")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical faces of every group."""
    face = table(spark, sf_dir, "face")
    out = clusters.describe(face, clusters.cluster(face, "face_id", "encoding"), "face_id", "encoding")
    return out.withColumn("typical", F.array_join("typical", ","))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group ids of all cluster ids linked by merge candidates."""
    out = boruvka.group_pairs(table(spark, sf_dir, "merge_candidate"), "id1", "id2")
    return out.select(F.col("id").cast("int").alias("cluster_id"), F.col("group_id").cast("int").alias("group_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of faces, and of centroids, in which one is among the other's three nearest."""
    face = neighbours.nearest(table(spark, sf_dir, "face"), "face_id", "encoding")
    centroid = neighbours.nearest(table(spark, sf_dir, "centroid"), "cluster_id", "vec")
    both = face.withColumn("kind", F.lit("face")).unionByName(centroid.withColumn("kind", F.lit("centroid")))
    return both.select("kind", F.least("id", "nbr").alias("id_1"), F.greatest("id", "nbr").alias("id_2")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 15 or more consecutive words of an item's passage."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that leak it; 0 for items that none leaks."""
    items = table(spark, sf_dir, "eval_item")
    n = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))


def _cluster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (cluster, original file); cut, as several steps read it."""
    rows = table(spark, sf_dir, "cluster_file").select("cluster_id", "media_path")
    return cut(together.baskets(together.through(rows, "media_path", table(spark, sf_dir, "frame"), "frame_path", "media_path"), "cluster_id", "media_path"))


_PAIR = ("cast(i as int) as cluster_id_1", "cast(j as int) as cluster_id_2")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clusters in at least 5 common files and at least 10 times as many as chance.

    Each is tested against the fitted null as in p4_pairs; the case rule, in whole numbers, follows.
    """
    links = _cluster_files(spark, sf_dir)
    return together.frequent(together.surprise(links, together.pair_counts(links, 5))).selectExpr(*_PAIR)


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of clusters with a common file, against the fitted null."""
    links = _cluster_files(spark, sf_dir)
    return together.surprise(links, together.pair_counts(links))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p4_pairs tests: common files, files of each and the ratio to independence."""
    return p4_pairs(spark, sf_dir).selectExpr(*_PAIR, "n", "a", "b", "n * cast(n_baskets as double) / (a * b) as lift")


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the mix in training order."""
    return mixture.mix(mixture.counted(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached, per source."""
    counts, goal = mixture.counted(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target")
    return mixture.shares(mixture.mix(counts, goal), counts, goal)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic.score(docs, toxic.model(docs, table(spark, sf_dir, "review_sample")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _scored(spark, sf_dir).where(F.col("score") >= toxic.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and kind for every document."""
    return _scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per source."""
    return toxic.rates(_scored(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_order": p7_order,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_USABLE = "len({0}) = 128 and list_count({0}) = 128 and isfinite(list_max({0})) and isfinite(list_min({0})) and (list_max({0}) <> 0 or list_min({0}) <> 0)"
_GROUPS = f"""
        with recursive f as (select distinct face_id as id, encoding from face where face_id is not null and {_USABLE.format('encoding')}),
        v as (select id, cast(encoding as double[128]) as v from f),
        e as (select a.id as a, b.id as b from v a join v b on a.id < b.id and array_distance(a.v, b.v) <= 0.6 + 1e-9),
        s as (select a, b from e union select b, a from e),
        r(id, g) as (select a, a from s union select s.b, r.g from r join s on s.a = r.id where r.g < s.b),
        c as (select id, min(g) as g from r group by id)"""


def _near(kind: str, table_: str, id_col: str, vec: str) -> str:
    """SQL of the pairs in which one is among the other's three nearest."""
    return f"""
        select distinct '{kind}' as kind, least(id, nbr) as id_1, greatest(id, nbr) as id_2 from (
            select id, nbr, row_number() over (partition by id order by d, nbr) as rn from (
                select id, nbr, min(d) as d from (
                    select a.id as id, b.id as nbr, round(array_distance(a.v, b.v), 6) as d
                    from (select distinct cast({id_col} as bigint) as id, cast({vec} as double[128]) as v from {table_} where {id_col} is not null and {_USABLE.format(vec)}) a,
                         (select distinct cast({id_col} as bigint) as id, cast({vec} as double[128]) as v from {table_} where {id_col} is not null and {_USABLE.format(vec)}) b
                    where a.id <> b.id and array_distance(a.v, b.v) < 0.6 + 1e-6)
                where d < 0.6 group by 1, 2))
        where rn <= 3"""


_TOGETHER = """
        with fr as (select frame_path, min(media_path) as m from frame where frame_path is not null and media_path is not null group by 1),
        it as (select distinct c.cluster_id as c, coalesce(fr.m, c.media_path) as f from cluster_file c left join fr on c.media_path = fr.frame_path
               where c.cluster_id is not null and c.media_path is not null),
        deg as (select c, count(*) as a from it group by c),
        total as (select count(distinct f) as n from it),
        p as (select a.c as c1, b.c as c2, count(*) as n from it a join it b on a.f = b.f and a.c < b.c group by 1, 2)"""

ORACLE = {
    "p1_found": _GROUPS + " select id as face_id, g as group_id from c",
    "p1_clusters": _GROUPS + """,
        x as (select c.g, v.id, generate_subscripts(f.encoding, 1) as pos, unnest(f.encoding) as x from c join v on v.id = c.id join f on f.id = c.id),
        m as (select g, pos, avg(x) as x from x group by 1, 2),
        d as (select x.g, x.id, round(sqrt(sum((x.x - m.x) * (x.x - m.x))), 9) as d from x join m on m.g = x.g and m.pos = x.pos group by 1, 2),
        n as (select *, row_number() over (partition by g order by d, id) as rn, count(*) over (partition by g) as n from d)
        select g as group_id, n as n_members, cast(min(id) filter (rn = 1) as bigint) as medoid, string_agg(cast(id as varchar), ',' order by rn) as typical
        from n where rn <= 3 group by g, n""",
    "p5_found": _near("face", "face", "face_id", "encoding") + " union all " + _near("centroid", "centroid", "cluster_id", "vec"),
    "p2_found": """
        with recursive e as (
            select distinct id1 as a, id2 as b from merge_candidate where id1 is not null and id2 is not null and id1 <> id2
        ), s as (select a, b from e union select b, a from e),
        r(id, g) as (
            select a, a from s
            union
            select s.b, r.g from r join s on s.a = r.id where r.g < s.b
        )
        select cast(id as integer) as cluster_id, cast(min(g) as integer) as group_id from r group by id""",
    "p4_found": _TOGETHER + """
        select c1 as cluster_id_1, c2 as cluster_id_2 from p join deg x on x.c = c1 join deg y on y.c = c2, total
        where p.n >= 5 and p.n * total.n >= 10 * x.a * y.a""",
    "p4_counts": _TOGETHER + """
        select c1 as cluster_id_1, c2 as cluster_id_2, p.n, x.a, y.a as b, p.n * cast(total.n as double) / (x.a * y.a) as lift
        from p join deg x on x.c = c1 join deg y on y.c = c2, total""",
}
