"""Token features, statuses, corruptions, retrieval, and graph queries over boxes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import family_of, grams, normalised
from ..operators import candidates as c
from ..operators import fuzzy, graph
from ..operators import layout as g
from ..registry import query
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, catalog, labelled_parts, predictions, table
from .catalog import _EDIT, _NORM
from .layout import _BOXES, _PAIRS, _boxes, _pairs


@query(
    "token_features",
    f"""WITH {PARTS_SQL} SELECT p_partkey, length(printed) AS n, length(regexp_replace(printed, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(printed, '[^A-Za-z]', '', 'g')) AS letters, printed LIKE '%*%' AS wild,
  regexp_extract(printed, '^[A-Za-z]+') AS head, printed = upper(printed) AS upper FROM printed""",
)
def token_features(spark, sf_dir):
    p = F.col("printed")
    left = lambda cls: F.length(F.regexp_replace(p, cls, "")).cast("long")
    return labelled_parts(spark, sf_dir).select("p_partkey", F.length(p).cast("long").alias("n"), left("[^0-9]").alias("digits"), left("[^A-Za-z]").alias("letters"), p.contains("*").alias("wild"), F.regexp_extract(p, "^[A-Za-z]+", 0).alias("head"), (p == F.upper(p)).alias("upper"))


@query(
    "match_status",
    f"""WITH {PARTS_SQL} SELECT p_partkey, CASE WHEN p.printed = c.label THEN 'exact' WHEN c.label IS NOT NULL THEN 'normalised' WHEN regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)', 1) <> '' THEN 'partial' ELSE 'unknown' END AS status
  FROM printed p LEFT JOIN catalog c ON c.label = {_NORM}""",
)
def match_status(spark, sf_dir):
    found = c.exact(labelled_parts(spark, sf_dir).select("p_partkey", "printed"), catalog(spark, sf_dir))
    status = F.when(F.col("printed") == F.col("section"), "exact").when(F.col("section").isNotNull(), "normalised").when(family_of(normalised(F.col("printed"))) != "", "partial").otherwise("unknown")
    return found.select("p_partkey", status.alias("status"))


@query(
    "category_classify",
    """SELECT doc_id, CASE WHEN contains(text, 'rights reserved') THEN 'license' WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'secret' WHEN contains(text, '|') THEN 'table' WHEN n_chars < 100 THEN 'short' ELSE 'prose' END AS category FROM documents""",
)
def category_classify(spark, sf_dir):
    t = F.col("text")
    category = F.when(t.contains("rights reserved"), "license").when(t.contains("@"), "contact").when(t.rlike("AKIA[0-9A-Z]{16}"), "secret").when(t.contains("|"), "table").when(F.col("n_chars") < 100, "short").otherwise("prose")
    return table(spark, sf_dir, "documents").select("doc_id", category.alias("category"))


@query("page_role", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.html$') THEN 'document' WHEN contains(url, '?') THEN 'listing' WHEN ends_with(url, '/') THEN 'index' ELSE 'page' END AS role, CASE WHEN length(html) < 1500 THEN 'small' WHEN length(html) < 6000 THEN 'medium' ELSE 'large' END AS size FROM pages")
def page_role(spark, sf_dir):
    u, n = F.col("url"), F.length("html")
    role = F.when(u.endswith(".html"), "document").when(u.contains("?"), "listing").when(u.endswith("/"), "index").otherwise("page")
    return table(spark, sf_dir, "pages").select("page_id", role.alias("role"), F.when(n < 1500, "small").when(n < 6000, "medium").otherwise("large").alias("size"))


@query(
    "field_compatible",
    f"""WITH {PARTS_SQL}, f AS (SELECT p_partkey, regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)([0-9*]+)X([0-9*]+)$', 1) AS family, regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)([0-9*]+)X([0-9*]+)$', 2) AS a, regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)([0-9*]+)X([0-9*]+)$', 3) AS b FROM printed)
SELECT f.p_partkey, c.label FROM f JOIN catalog c ON c.family = f.family AND length(CAST(c.depth AS VARCHAR)) = length(f.a) AND length(CAST(c.weight AS VARCHAR)) = length(f.b) AND CAST(c.depth AS VARCHAR) LIKE replace(f.a, '*', '_') AND CAST(c.weight AS VARCHAR) LIKE replace(f.b, '*', '_')""",
)
def field_compatible(spark, sf_dir):
    """Labels of the same family whose fields have the same lengths and characters, wildcards aside."""
    read, norm = "^(WT|HP|MC|W|M|C)([0-9*]+)X([0-9*]+)$", normalised(F.col("printed"))
    asked = labelled_parts(spark, sf_dir).select("p_partkey", *[F.regexp_extract(norm, read, i).alias(n) for i, n in enumerate(("family", "a", "b"), 1)])
    size = lambda x, y: (F.length(x).alias("na"), F.length(y).alias("nb"))
    asked = asked.select("p_partkey", "family", *size("a", "b"), F.translate(F.concat_ws("X", "a", "b"), "*", "_").alias("mask"))
    fields = catalog(spark, sf_dir).select("family", "label", F.col("depth").cast("string").alias("x"), F.col("weight").cast("string").alias("y"))
    labels = fields.select("family", "label", *size("x", "y"), F.concat_ws("X", "x", "y").alias("text"))
    by = ["family", "na", "nb"]
    return asked.join(c.fitting(asked, labels, by), [*by, "mask"]).select("p_partkey", "label")


@query(
    "pair_features",
    f"""WITH {PARTS_SQL}, {_EDIT} SELECT e.p_partkey, e.label, e.distance, abs(length({_NORM}) - length(e.label)) AS length_gap, regexp_extract({_NORM}, '^(WT|HP|MC|W|M|C)', 1) = regexp_extract(e.label, '^(WT|HP|MC|W|M|C)', 1) AS same_family,
  regexp_replace({_NORM}, '[^0-9]', '', 'g') = regexp_replace(e.label, '[^0-9]', '', 'g') AS same_digits, e.label = p.label AS correct FROM edited e JOIN printed p ON p.p_partkey = e.p_partkey WHERE e.place <= 3""",
)
def pair_features(spark, sf_dir):
    parts = labelled_parts(spark, sf_dir).select("p_partkey", "printed", F.col("label").alias("true_label"))
    near = c.edit_distance(parts, catalog(spark, sf_dir)).join(parts, "p_partkey")
    norm, digits = normalised(F.col("printed")), lambda x: F.regexp_replace(x, "[^0-9]", "")
    return near.select("p_partkey", "label", "distance", F.abs(F.length(norm) - F.length("label")).cast("long").alias("length_gap"), (family_of(norm) == family_of(F.col("label"))).alias("same_family"), (digits(norm) == digits(F.col("label"))).alias("same_digits"), (F.col("label") == F.col("true_label")).alias("correct"))


@query("kb_stats", f"WITH {PARTS_SQL} SELECT family, count(DISTINCT label) AS labels, count(DISTINCT printed) AS prints, count(*) FILTER (printed <> label) AS damaged, count(*) AS n FROM printed GROUP BY family")
def kb_stats(spark, sf_dir):
    return labelled_parts(spark, sf_dir).groupBy("family").agg(F.countDistinct("label").alias("labels"), F.countDistinct("printed").alias("prints"), F.count(F.when(F.col("printed") != F.col("label"), 1)).alias("damaged"), F.count(F.lit(1)).alias("n"))


@query(
    "corruptions",
    f"""WITH {PARTS_SQL}, k AS (SELECT label, part, CAST(part % length(label) + 1 AS BIGINT) AS spot FROM catalog)
SELECT label, unnest(['drop', 'wild', 'double', 'confuse']) AS kind, unnest([substr(label, 1, spot - 1) || substr(label, spot + 1), substr(label, 1, spot - 1) || '*' || substr(label, spot + 1), substr(label, 1, spot) || substr(label, spot), translate(label, '015', 'OIS')]) AS damaged FROM k""",
)
def corruptions(spark, sf_dir):
    """Four kinds of damage at a place that the part's key decides."""
    k = catalog(spark, sf_dir).withColumn("at", (F.col("part") % F.length("label") + 1).cast("int"))
    before, upto = F.expr("substring(label, 1, at - 1)"), F.expr("substring(label, 1, at)")
    rest, after = F.expr("substring(label, at)"), F.expr("substring(label, at + 1)")
    kinds = {"drop": F.concat(before, after), "wild": F.concat(before, F.lit("*"), after), "double": F.concat(upto, rest), "confuse": F.translate("label", "015", "OIS")}
    return k.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("damaged")) for n, v in kinds.items()])).alias("x")).select("label", "x.*")


@query(
    "tfidf_retrieval",
    f"""WITH {PARTS_SQL}, d AS (SELECT DISTINCT label, substr(label, CAST(i AS BIGINT), 2) AS gram FROM catalog, unnest(range(1, length(label))) AS u(i)), p AS (SELECT DISTINCT p_partkey, substr({_NORM}, CAST(i AS BIGINT), 2) AS gram FROM printed, unnest(range(1, length({_NORM}))) AS u(i)),
w AS (SELECT gram, pow(ln((1 + (SELECT count(*) FROM catalog)) / (1.0::DOUBLE + count(*))) + 1, 2) AS w FROM d GROUP BY gram), nd AS (SELECT label, sum(w) AS s FROM d JOIN w USING (gram) GROUP BY label), np AS (SELECT p_partkey, sum(w) AS s FROM p JOIN w USING (gram) GROUP BY p_partkey),
x AS (SELECT p_partkey, label, sum(w) AS s FROM p JOIN d USING (gram) JOIN w USING (gram) GROUP BY 1, 2), s AS (SELECT x.p_partkey, x.label, round(x.s / sqrt(nd.s * np.s), 6) AS score FROM x JOIN nd USING (label) JOIN np USING (p_partkey))
SELECT p_partkey, label, score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, label) = 1""",
)
def tfidf_retrieval(spark, sf_dir):
    """The label of the greatest cosine of bigram weights; blocks of distinct prints and of labels meet as matrices."""
    labels = catalog(spark, sf_dir)
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    d = labels.select("label", F.explode(grams(F.col("label"), 2)).alias("gram"))
    named = labelled_parts(spark, sf_dir).select("p_partkey", normalised(F.col("printed")).alias("norm"))
    p = named.select("norm").distinct().select("norm", F.explode(grams(F.col("norm"), 2)).alias("gram"))
    counts = d.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    w = counts.select("gram", F.pow(F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1, F.lit(2)).alias("w"))
    dw, pw = d.join(w, "gram"), p.join(w, "gram")
    near = fuzzy.nearest_by_cosine(pw, dw)
    score = near.select("norm", F.struct(F.round(-F.col("s") / F.sqrt(F.col("sd") * F.col("sp")), 6).alias("less"), "label").alias("hit"))
    best = score.groupBy("norm").agg(F.min("hit").alias("hit"))
    return named.join(best, "norm").select("p_partkey", "hit.label", (-F.col("hit.less")).alias("score"))


@query("boilerplate_slots", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS slot FROM l) SELECT slot, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s GROUP BY slot HAVING count(DISTINCT doc_id) >= 3")
def boilerplate_slots(spark, sf_dir):
    """Lines that three documents and more share, numbers aside."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.regexp_replace("line", "[0-9]+", "#").alias("slot"))
    per_doc = lines.groupBy("slot", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("slot").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")).filter("docs >= 3")


@query(
    "anonymous_resolution",
    f"""WITH {PREDICTIONS_SQL}, k AS (SELECT page, section, count(*) AS n FROM predictions WHERE section IS NOT NULL GROUP BY 1, 2), best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, section) = 1)
SELECT p.page, best.section, best.n AS support, count(*) AS resolved FROM predictions p JOIN best ON best.page = p.page WHERE p.section IS NULL GROUP BY ALL""",
)
def anonymous_resolution(spark, sf_dir):
    """Predictions without a section take the most frequent one of their page."""
    rows = predictions(spark, sf_dir)
    counts = rows.filter("section is not null").groupBy("page", "section").agg(F.count(F.lit(1)).alias("n"))
    best = c.first_of(counts, ["page"], [F.desc("n"), F.col("section")], 1).select("page", "section", F.col("n").alias("support"))
    missing = rows.filter("section is null").groupBy("page").agg(F.count(F.lit(1)).alias("resolved"))
    return missing.join(best, "page").select("page", "section", "support", "resolved")


@query(
    "duplicate_iou",
    f"""WITH {_PAIRS}, o AS (SELECT page, box, box_b, greatest(0, least(x1, x1_b) - greatest(x0, x0_b)) * greatest(0, least(y1, y1_b) - greatest(y0, y0_b)) AS i, (x1 - x0) * (y1 - y0) AS a, (x1_b - x0_b) * (y1_b - y0_b) AS b FROM pairs WHERE box < box_b)
SELECT page, box, box_b, round(i / (a + b - i), 6) AS iou FROM o WHERE 10 * i >= 3 * (a + b - i)""",
)
def duplicate_iou(spark, sf_dir):
    zero = F.lit(0).cast("long")
    side = lambda k: F.greatest(zero, F.least(f"{k}1", f"{k}1_b") - F.greatest(f"{k}0", f"{k}0_b"))
    o = _pairs(spark, sf_dir).filter(F.col("box") < F.col("box_b")).select("page", "box", "box_b", (side("x") * side("y")).alias("i"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) + (F.col("x1_b") - F.col("x0_b")) * (F.col("y1_b") - F.col("y0_b"))).alias("ab"))
    return o.filter("10 * i >= 3 * (ab - i)").select("page", "box", "box_b", F.round(F.col("i") / (F.col("ab") - F.col("i")), 6).alias("iou"))


@query(
    "pair_coverage",
    f"""WITH {_PAIRS}, o AS (SELECT page, box, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box) AS place FROM b), t AS (SELECT p.page, abs(x.place - y.place) <= 11 AS near FROM pairs p JOIN o x ON x.page = p.page AND x.box = p.box JOIN o y ON y.page = p.page AND y.box = p.box_b WHERE p.box < p.box_b)
SELECT page, count(*) AS complete, count(*) FILTER (near) AS windowed FROM t GROUP BY page""",
)
def pair_coverage(spark, sf_dir):
    """How many of the near pairs a window of 11 in reading order would have found."""
    order = _boxes(spark, sf_dir).select("page", "box", F.row_number().over(W.partitionBy("page").orderBy("y0", "x0", "box")).alias("place"))
    pairs = _pairs(spark, sf_dir).filter(F.col("box") < F.col("box_b")).select("page", "box", "box_b")
    both = pairs.join(order, ["page", "box"]).join(order.select("page", F.col("box").alias("box_b"), F.col("place").alias("other")), ["page", "box_b"])
    return both.groupBy("page").agg(F.count(F.lit(1)).alias("complete"), F.count(F.when(F.abs(F.col("place") - F.col("other")) <= 11, 1)).alias("windowed"))


@query(
    "label_propagation",
    f"""WITH {_PAIRS}, seeds AS (SELECT page, box, x1 - x0 AS strength FROM b WHERE x1 - x0 >= 13), n AS (SELECT p.page, p.box, s.box AS seed, s.strength FROM pairs p JOIN seeds s ON s.page = p.page AND s.box = p.box_b)
SELECT page, box, seed, strength FROM n WHERE (page, box) NOT IN (SELECT (page, box) FROM seeds) QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY strength DESC, seed DESC) = 1""",
)
def label_propagation(spark, sf_dir):
    seeds = _boxes(spark, sf_dir).select("page", "box", (F.col("x1") - F.col("x0")).alias("strength")).filter("strength >= 13")
    return graph.strongest_seed(_pairs(spark, sf_dir).select("page", "box", "box_b"), seeds)


@query(
    "one_to_one",
    f"""WITH {_PAIRS}, n AS (SELECT page, box, box_b, d2 FROM pairs QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY d2, box_b) = 1)
SELECT x.page, x.box, x.box_b, x.d2 FROM n x JOIN n y ON x.page = y.page AND x.box = y.box_b AND x.box_b = y.box WHERE x.box < x.box_b""",
)
def one_to_one(spark, sf_dir):
    return graph.mutual_nearest(_pairs(spark, sf_dir))


@query(
    "components_near",
    f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT page || ':' || box AS x, page || ':' || box_b AS y FROM pairs), r AS (SELECT DISTINCT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""",
)
def components_near(spark, sf_dir):
    name = lambda b: F.concat_ws(":", "page", b)
    return graph.components(_pairs(spark, sf_dir).select(name("box").alias("x"), name("box_b").alias("y")), "x", "y")


@query(
    "correction_score",
    f"""WITH {PREDICTIONS_SQL}, s AS (SELECT source, section, 0.45::DOUBLE * confidence + 0.35::DOUBLE * (0.65::DOUBLE * CASE WHEN section IS NULL THEN 0.55::DOUBLE WHEN family IN ('W', 'WT') THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END + 0.35::DOUBLE * (quantity / 50.0::DOUBLE)) AS x, CASE WHEN eligible IS NULL THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS w, CASE WHEN eligible THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS e FROM predictions)
SELECT source, count(*) AS n, round(avg((x + e) / w), 6) AS score FROM s GROUP BY source""",
)
def correction_score(spark, sf_dir):
    """A sum of signals over the weights at hand: confidence, context (family and rule) and scope."""
    context = 0.65 * F.when(F.col("section").isNull(), 0.55).when(F.col("family").isin("W", "WT"), 1.0).otherwise(0.15) + 0.35 * (F.col("quantity") / 50.0)
    scope, weight = F.when(F.col("eligible"), 0.2).otherwise(0.0), F.when(F.col("eligible").isNull(), 0.8).otherwise(1.0)
    score = (0.45 * F.col("confidence") + 0.35 * context + scope) / weight
    return predictions(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("score"))
