"""What annotations, notes, titles and references say, and the gates before they are believed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.labels import closed_json, normalised
from ..registry import query
from ..sources.scratch import scratch_path
from ..sources.tables import PARTS_SQL, PREDICTIONS_SQL, labelled_parts, predictions, table
from .catalog import _NORM


def _n():
    return F.count(F.lit(1)).alias("n")


def _found(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(held, F.lit(name)) for name, held in conditions.items()]))


def _found_sql(conditions: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {held} THEN '{name}' END" for name, held in conditions.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "plausible_labels",
    f"""WITH {PARTS_SQL}, p AS (SELECT p_partkey, {_NORM} AS norm FROM printed), q AS (SELECT p_partkey, norm, regexp_extract(norm, '^(WT|HP|MC|W|M|C)', 1) AS family, TRY_CAST(regexp_extract(norm, '^(?:WT|HP|MC|W|M|C)([0-9]+)X', 1) AS BIGINT) AS depth FROM p)
SELECT q.p_partkey, c.label AS candidate, q.norm = '' OR (q.family = c.family AND (q.depth IS NULL OR q.depth = c.depth)) AS plausible FROM q JOIN parts c ON c.p_partkey = q.p_partkey + 1 - 2 * (q.p_partkey % 2)""",
)
def plausible_labels(spark, sf_dir):
    """Whether a candidate keeps the family and depth of the print, where the print shows them."""
    parts, norm = labelled_parts(spark, sf_dir), normalised(F.col("printed"))
    read = parts.select("p_partkey", norm.alias("norm"), F.regexp_extract(norm, "^(WT|HP|MC|W|M|C)", 1).alias("f"), F.nullif(F.regexp_extract(norm, "^(?:WT|HP|MC|W|M|C)([0-9]+)X", 1), F.lit("")).cast("long").alias("d"), (F.col("p_partkey") + 1 - 2 * (F.col("p_partkey") % 2)).alias("other"))
    pairs = read.join(parts.select(F.col("p_partkey").alias("other"), F.col("label").alias("candidate"), "family", "depth"), "other")
    return pairs.select("p_partkey", "candidate", ((F.col("norm") == "") | ((F.col("f") == F.col("family")) & (F.col("d").isNull() | (F.col("d") == F.col("depth"))))).alias("plausible"))


_CALLOUT = """CASE p_partkey % 9 WHEN 0 THEN 'PL 3/' || (1 + depth % 16) || 'X' || weight WHEN 1 THEN (1 + weight % 7) || '/8" BENT PL' WHEN 2 THEN depth || 'X' || weight || 'X1/4' WHEN 3 THEN '6X6-W2.9XW2.9' WHEN 4 THEN 'PIPE' || depth WHEN 5 THEN ''
  WHEN 6 THEN 'CAP PLATE ' || (1 + depth % 3) WHEN 7 THEN 'BENT PLATE ' || (1 + weight % 7) || '/8"' ELSE label END"""
_PLATE_HEAD = "^((CAP|CONN(ECTION)?) +PL(ATE)?|PL|PLATE|BP|BENT *PL(ATE)?)( |[0-9]|$)"
_THICK = "([0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?)"
_FIRST_BENT, _FIRST_PLATE = f'^{_THICK}"? *BENT *PL(ATE)?( |$)', f'^{_THICK}"? *((CAP|CONN(ECTION)?) +)?PL(ATE)?( |$)'
_AFTER = f"^BENT *PL(?:ATE)? *{_THICK}"


@query(
    "plate_callouts",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_CALLOUT} AS raw FROM parts)
SELECT p_partkey, raw, regexp_matches(raw, '{_PLATE_HEAD}') AS plate_head, regexp_matches(raw, '{_FIRST_PLATE}') AND NOT regexp_matches(raw, '{_FIRST_BENT}') AS thickness_first,
  CASE WHEN regexp_matches(raw, '{_FIRST_BENT}') THEN regexp_extract(raw, '{_FIRST_BENT}', 1) WHEN regexp_matches(raw, '{_AFTER}') THEN regexp_extract(raw, '{_AFTER}', 1) END AS thickness FROM s""",
)
def plate_callouts(spark, sf_dir):
    """Plates by name or by a leading thickness, and the thickness of bent ones."""
    rows, raw = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_CALLOUT).alias("raw")), F.col("raw")
    bent = raw.rlike(_FIRST_BENT)
    thickness = F.when(bent, F.regexp_extract(raw, _FIRST_BENT, 1)).when(raw.rlike(_AFTER), F.regexp_extract(raw, _AFTER, 1))
    return rows.select("p_partkey", "raw", raw.rlike(_PLATE_HEAD).alias("plate_head"), (raw.rlike(_FIRST_PLATE) & ~bent).alias("thickness_first"), thickness.alias("thickness"))


_MESH, _BARE = "^[0-9]+X[0-9]+-[WD][0-9.]+X[WD][0-9.]+$", "^[0-9./-]+(X[0-9./-]+)+$"


@query(
    "reconstruction_gate",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_CALLOUT} AS raw FROM parts) SELECT p_partkey, raw, CASE WHEN raw = '' THEN 'empty' WHEN raw LIKE 'PIPE%' THEN 'open' WHEN regexp_matches(raw, '{_PLATE_HEAD}') THEN 'plate'
  WHEN regexp_matches(raw, '{_MESH}') THEN 'mesh' WHEN regexp_matches(raw, '^(WT|HP|MC|W|M|C)[0-9*?]') THEN 'open' WHEN regexp_matches(raw, '{_BARE}') OR regexp_matches(raw, '{_FIRST_PLATE}') OR regexp_matches(raw, '{_FIRST_BENT}') THEN 'no_family' ELSE 'open' END AS gate FROM s""",
)
def reconstruction_gate(spark, sf_dir):
    """What may be rebuilt into a section: not plates, mesh, or dimensions without a family."""
    rows, raw = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_CALLOUT).alias("raw")), F.col("raw")
    bare = raw.rlike(_BARE) | raw.rlike(_FIRST_PLATE) | raw.rlike(_FIRST_BENT)
    gate = F.when(raw == "", "empty").when(raw.startswith("PIPE"), "open").when(raw.rlike(_PLATE_HEAD), "plate").when(raw.rlike(_MESH), "mesh").when(raw.rlike("^(WT|HP|MC|W|M|C)[0-9*?]"), "open").when(bare, "no_family").otherwise("open")
    return rows.select("p_partkey", "raw", gate.alias("gate"))


_FOLD = "regexp_replace(upper(printed), '[^A-Z0-9]', '', 'g')"
_DIGITS = "length(regexp_replace({}, '[^0-9]', '', 'g'))"
_KINDS = {
    "wrong_prefix": "regexp_extract(a, '^(WT|HP|MC|W|M|C)', 1) <> regexp_extract(b, '^(WT|HP|MC|W|M|C)', 1)",
    "missing_digits": f"{_DIGITS.format('a')} < {_DIGITS.format('b')}",
    "missing_separator": "a NOT LIKE '%X%' AND b LIKE '%X%'",
    "ocr_or_typo": "length(a) = length(b)",
    "merged_or_split_label": f"length(a) <> length(b) AND {_DIGITS.format('a')} = {_DIGITS.format('b')}",
}


@query(
    "issue_types",
    f"""WITH {PARTS_SQL}, f AS (SELECT p_partkey, {_FOLD} AS a, label AS b FROM printed), k AS (SELECT p_partkey, a, b, {_found_sql(_KINDS)} AS found FROM f)
SELECT p_partkey, CASE WHEN a = b THEN '' WHEN a = '' THEN 'missing_label' WHEN len(found) = 0 THEN 'wrong_label' ELSE array_to_string(found, ',') END AS issues FROM k""",
)
def issue_types(spark, sf_dir):
    """What kind of damage turns the label into its print, from lengths, digits and beginnings."""
    a, b = F.col("a"), F.col("b")
    family = lambda x: F.regexp_extract(x, "^(WT|HP|MC|W|M|C)", 1)
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    same = F.length(a) == F.length(b)
    kinds = (family(a) != family(b), digits(a) < digits(b), ~a.contains("X") & b.contains("X"), same, ~same & (digits(a) == digits(b)))
    rows = labelled_parts(spark, sf_dir).select("p_partkey", F.regexp_replace(F.upper("printed"), "[^A-Z0-9]", "").alias("a"), F.col("label").alias("b"))
    found = _found(dict(zip(_KINDS, kinds)))
    return rows.select("p_partkey", F.when(a == b, "").when(a == "", "missing_label").when(F.size(found) == 0, "wrong_label").otherwise(F.array_join(found, ",")).alias("issues"))


_QUOTED = """WITH w AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM documents), s AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM w),
q AS (SELECT doc_id, text, array_to_string(ws[1:6], ' ') AS statement, CASE doc_id % 3 WHEN 0 THEN array_to_string(ws[3:8], ' ') WHEN 1 THEN array_to_string(list_reverse(ws[3:8]), ' ') ELSE ws[1] END AS quote FROM s WHERE len(ws) >= 8)"""


@query(
    "quote_grounding",
    f"""{_QUOTED}, t AS (SELECT *, regexp_replace(quote, '[^a-z0-9]', '', 'g') AS bare FROM q) SELECT doc_id, contains(text, quote) AS grounded, len(list_intersect(list_filter(string_split(statement, ' '), lambda x: length(x) >= 4), list_filter(string_split(quote, ' '), lambda x: length(x) >= 4))) > 0 AS supported,
  NOT (length(quote) >= 12 AND contains(quote, ' ')) AND bare <> '' AND (length(statement) - length(replace(statement, bare, ''))) / length(bare) >= 2 AS circular FROM t""",
)
def quote_grounding(spark, sf_dir):
    """Whether a quote stands in its text, shares a word of four letters with the statement, and is more than the statement's own token."""
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))
    s = table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).withColumn("ws", F.filter(F.split("text", " "), lambda x: x != "")).filter("size(ws) >= 8")
    some = F.slice("ws", 3, 6)
    quote = F.when(F.col("doc_id") % 3 == 0, F.array_join(some, " ")).when(F.col("doc_id") % 3 == 1, F.array_join(F.reverse(some), " ")).otherwise(F.col("ws")[0])
    q = s.select("doc_id", "text", F.array_join(F.slice("ws", 1, 6), " ").alias("statement"), quote.alias("quote")).withColumn("bare", F.regexp_replace("quote", "[^a-z0-9]", ""))
    long_ = lambda c: F.filter(F.split(c, " "), lambda x: F.length(x) >= 4)
    times = F.try_divide(F.length("statement") - F.length(F.replace("statement", F.col("bare"), F.lit(""))), F.length("bare"))
    circular = ~((F.length("quote") >= 12) & F.col("quote").contains(" ")) & (F.col("bare") != "") & (times >= 2)
    return q.select("doc_id", F.contains("text", "quote").alias("grounded"), F.arrays_overlap(long_("statement"), long_("quote")).alias("supported"), F.coalesce(circular, F.lit(False)).alias("circular"))


_NOTE = "CASE l_linenumber % 4 WHEN 0 THEN 'TYP' WHEN 1 THEN 'SEE ' || l_linenumber || '/S-' || l_suppkey WHEN 2 THEN (1 + l_partkey % 4) || ' / S' || l_suppkey ELSE 'SEE S-' || l_suppkey END"
_REFERENCE, _SHEET = "(?:^|[^A-Z0-9/])([A-Z0-9]{1,3}) */ *(S-?[0-9]+)", "(S-?[0-9]+)"
_SHEETS = """sheets AS (SELECT 'S-' || s_suppkey AS sheet, s_suppkey AS page FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'S' || s_suppkey, -s_suppkey FROM supplier WHERE s_suppkey % 20 = 0),
owners AS (SELECT regexp_replace(sheet, '[^A-Z0-9]', '', 'g') AS id, min(page) AS page, min(sheet) AS sheet, count(*) AS k FROM sheets GROUP BY 1),
views AS (SELECT s_suppkey AS page, CAST(1 + i % 3 AS VARCHAR) AS number, count(*) AS k FROM supplier, unnest(range(0, 1 + s_suppkey % 5)) AS u(i) GROUP BY 1, 2)"""


@query(
    "reference_resolution",
    f"""WITH {_SHEETS}, n AS (SELECT l_orderkey, l_partkey, l_linenumber, {_NOTE} AS raw FROM lineitem), r AS (SELECT *, nullif(regexp_extract(raw, '{_REFERENCE}', 1), '') AS number, coalesce(nullif(regexp_extract(raw, '{_REFERENCE}', 2), ''), nullif(regexp_extract(raw, '{_SHEET}', 1), '')) AS named FROM n)
SELECT l_orderkey, l_partkey, l_linenumber, raw, r.number, CASE WHEN named IS NULL OR o.k > 1 THEN 'ambiguous' WHEN o.k IS NULL THEN 'target_missing' WHEN r.number IS NULL THEN 'target_sheet_found' WHEN v.k = 1 THEN 'target_view_found' WHEN v.k > 1 THEN 'ambiguous' ELSE 'target_sheet_only' END AS status,
  CASE WHEN o.k = 1 THEN o.sheet END AS target FROM r LEFT JOIN owners o ON o.id = regexp_replace(named, '[^A-Z0-9]', '', 'g') LEFT JOIN views v ON o.k = 1 AND v.page = o.page AND v.number = r.number""",
)
def reference_resolution(spark, sf_dir):
    """Notes that name a view and sheet, against the sheets' compact ids and printed view numbers; nothing is guessed."""
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    compact = lambda c: F.regexp_replace(c, "[^A-Z0-9]", "")
    name = lambda head: F.concat(F.lit(head), key.cast("string")).alias("sheet")
    sheets = supplier.filter(key % 7 != 0).select(name("S-"), key.alias("page")).unionByName(supplier.filter(key % 20 == 0).select(name("S"), (-key).alias("page")))
    owners = sheets.groupBy(compact("sheet").alias("id")).agg(F.min("page").alias("page"), F.min("sheet").alias("sheet"), F.count(F.lit(1)).alias("owners"))
    drawn = supplier.select(key.alias("page"), F.explode(F.sequence(F.lit(0).cast("long"), (key % 5).cast("long"))).alias("i"))
    views = drawn.groupBy("page", (1 + F.col("i") % 3).cast("string").alias("number")).agg(F.count(F.lit(1)).alias("views"))
    notes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.expr(_NOTE).alias("raw"))
    part = lambda pattern, k: F.nullif(F.regexp_extract("raw", pattern, k), F.lit(""))
    read = notes.withColumn("number", part(_REFERENCE, 1)).withColumn("named", F.coalesce(part(_REFERENCE, 2), part(_SHEET, 1))).withColumn("id", compact("named"))
    met = read.join(owners, "id", "left").withColumn("page", F.when(F.col("owners") == 1, F.col("page"))).join(views, ["page", "number"], "left")
    c = F.col
    status = F.when(c("named").isNull() | (c("owners") > 1), "ambiguous").when(c("owners").isNull(), "target_missing").when(c("number").isNull(), "target_sheet_found").when(c("views") == 1, "target_view_found").when(c("views") > 1, "ambiguous").otherwise("target_sheet_only")
    return met.select("l_orderkey", "l_partkey", "l_linenumber", "raw", "number", status.alias("status"), F.when(c("owners") == 1, c("sheet")).alias("target"))


@query("closed_props")
def closed_props(spark, sf_dir):
    """Properties cut off in the middle, closed again and read; what is no JSON even then stays unread."""
    events = table(spark, sf_dir, "events").select("event_id", F.expr("substring(props, 1, cast(pmod(event_id, length(props) + 1) as int))").alias("raw"))
    return events.select("event_id", "raw", closed_json(F.col("raw")).alias("closed")).withColumn("read", F.get_json_object("closed", "$").isNotNull())


_NOTES = """CASE p_partkey % 5 WHEN 0 THEN '"' || family || '" = ' || p_type || '; "' || p_brand || '" = ' || family || depth WHEN 1 THEN '"' || family || '" = ' || p_brand WHEN 2 THEN family || ' = plain' ELSE '"' || p_type || '" = ' || family || '; SEE NOTES' END"""
_ABBREVIATION = '"([^"]+)" = ([^;]+)'


@query(
    "abbreviation_rules",
    f"""WITH {PARTS_SQL}, s AS (SELECT {_NOTES} AS note FROM parts JOIN part USING (p_partkey, p_brand)), r AS (SELECT unnest(regexp_extract_all(note, '{_ABBREVIATION}', 1)) AS short, trim(unnest(regexp_extract_all(note, '{_ABBREVIATION}', 2))) AS meaning FROM s)
SELECT short, min(meaning) AS meaning, count(DISTINCT meaning) AS meanings, count(*) AS n, count(DISTINCT meaning) = 1 AS resolved FROM r GROUP BY short""",
)
def abbreviation_rules(spark, sf_dir):
    """Abbreviations that notes define as "X" = Y, and whether all notes agree."""
    notes = labelled_parts(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").select(F.expr(_NOTES).alias("note"))
    every = lambda k: F.regexp_extract_all("note", F.lit(_ABBREVIATION), F.lit(k))
    rules = notes.select(F.explode(F.arrays_zip(every(1).alias("short"), every(2).alias("meaning"))).alias("r")).select("r.short", F.trim("r.meaning").alias("meaning"))
    counted = rules.groupBy("short", "meaning").agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy("short").agg(F.min("meaning").alias("meaning"), F.count(F.lit(1)).alias("meanings"), F.sum("k").alias("n")).withColumn("resolved", F.col("meanings") == 1)


_CODES = {
    "missing_section": ("section IS NULL", "error"), "low_confidence": ("confidence < 0.55", "warning"), "scope_unknown": ("eligible IS NULL", "warning"),
    "out_of_scope": ("NOT eligible", "info"), "schedule_cell": ("is_schedule", "info"), "geometry_only": ("source = 'GEOMETRY' AND section IS NULL", "error"), "multiplier_ignored": ("typ_count = 1 OR typ_count > 20", "warning"),
}


@query(
    "token_issues",
    f"""WITH {PREDICTIONS_SQL}, i AS (SELECT page, unnest({_found_sql({k: v[0] for k, v in _CODES.items()})}) AS code FROM predictions) SELECT page, code, CASE code {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _CODES.items())} END AS severity, count(*) AS n FROM i GROUP BY page, code""",
)
def token_issues(spark, sf_dir):
    """Issue codes of every prediction with their severity, counted by page; a row may raise several."""
    raised = predictions(spark, sf_dir).select("page", F.explode(_found({k: F.expr(v[0]) for k, v in _CODES.items()})).alias("code"))
    severity = F.coalesce(*[F.when(F.col("code") == k, v[1]) for k, v in _CODES.items()])
    return raised.groupBy("page", "code").agg(_n()).select("page", "code", severity.alias("severity"), "n")


_SIZE_NOTE = """CASE p_partkey % 6 WHEN 0 THEN depth || chr(39) || '-6"x' || weight || chr(39) || '-0"' WHEN 1 THEN '(E) ' || depth || chr(39) || '-' || (weight % 12) || '"' WHEN 2 THEN 'C' || depth || ' ' || weight || chr(39) WHEN 3 THEN depth || chr(39) || ' ' || label WHEN 4 THEN CAST(depth AS {}) || '"' ELSE label END"""
_FEET_PART = "[0-9]{1,4} *' *-? *[0-9]{0,2}( +[0-9]+/[0-9]+)? *\"?"
_FEET_PAIR = f"({_FEET_PART} *[x×] *)+{_FEET_PART}"


def _sql(text: str) -> str:
    return text.replace("'", "''")


@query(
    "feet_inch_noise",
    f"""WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_SIZE_NOTE.format("VARCHAR")} AS raw FROM parts), f AS (SELECT *, regexp_matches(raw, '{_sql(_FEET_PART)}') AS feet, regexp_matches(raw, '{_sql(_FEET_PAIR)}') OR (regexp_matches(raw, '\\( *[EF] *\\)') AND regexp_matches(raw, '{_sql(_FEET_PART)}')) AS footing FROM s)
SELECT p_partkey, raw, feet, footing, NOT regexp_matches(raw, '^(BP|CL|L|C)[-_]?[0-9]+[A-Z]?( |$)') AND (footing OR (feet AND regexp_matches(raw, '^[0-9]{{1,2}}[^X]*$'))) AS noise FROM f""",
)
def feet_inch_noise(spark, sf_dir):
    """Sizes of footings and bare lengths in feet and inches, which are no section; marks of a schedule never are noise."""
    rows, raw = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_SIZE_NOTE.format("STRING")).alias("raw")), F.col("raw")
    feet = raw.rlike(_FEET_PART)
    footing = raw.rlike(_FEET_PAIR) | (raw.rlike("\\( *[EF] *\\)") & feet)
    noise = ~raw.rlike("^(BP|CL|L|C)[-_]?[0-9]+[A-Z]?( |$)") & (footing | (feet & raw.rlike("^[0-9]{1,2}[^X]*$")))
    return rows.select("p_partkey", "raw", feet.alias("feet"), footing.alias("footing"), noise.alias("noise"))


#: The words of sheet titles, of which each stand-in title takes some.
_TITLE_WORDS = ("DETAILS", "SECTION", "ELEVATION", "SCHEDULE", "PLAN", "FRAMING", "FOUNDATION", "ROOF", "LOADING", "NOTES")
_TITLE = "concat_ws(' ', " + ", ".join(f"CASE WHEN p_partkey * 7919 // {3 ** i} % 3 = 0 THEN '{w}' END" for i, w in enumerate(_TITLE_WORDS)) + ")"
_SHEET_KINDS = {"detail": "t LIKE '%DETAILS%'", "section": "t LIKE '%SECTION%'", "elevation": "t LIKE '%ELEVATION%'", "schedule": "t LIKE '%SCHEDULE%'", "plan": "(t LIKE '%PLAN%' OR t LIKE '%FRAMING%') AND t NOT LIKE '%DETAILS%' AND t NOT LIKE '%SECTION%'"}
_SHEET_ROLE = """CASE WHEN t = '' THEN 'unknown' WHEN t LIKE '%LOADING%' AND t NOT LIKE '%DETAILS%' AND t NOT LIKE '%SECTION%' AND t NOT LIKE '%ELEVATION%' THEN 'loading' WHEN k > 1 THEN 'review'
  WHEN t LIKE '%DETAILS%' AND t LIKE '%FOUNDATION%' THEN 'foundation_details' WHEN t LIKE '%DETAILS%' THEN 'detail' WHEN t LIKE '%SECTION%' THEN 'section' WHEN t LIKE '%ELEVATION%' THEN 'elevation' WHEN t LIKE '%SCHEDULE%' THEN 'schedule'
  WHEN k = 1 AND t LIKE '%FOUNDATION%' THEN 'foundation_plan' WHEN k = 1 AND t LIKE '%ROOF%' THEN 'roof_plan' WHEN k = 1 THEN 'framing_plan' WHEN t LIKE '%NOTES%' THEN 'general_notes' ELSE 'review' END"""


@query(
    "sheet_title_roles",
    f"""WITH s AS (SELECT p_partkey, {_TITLE} AS t FROM part), c AS (SELECT *, {_found_sql(_SHEET_KINDS)} AS kinds FROM s), k AS (SELECT *, len(kinds) AS k FROM c) SELECT p_partkey, t AS title, {_SHEET_ROLE} AS role, CASE WHEN {_SHEET_ROLE} = 'review' AND k > 1 THEN array_to_string(kinds, ',') ELSE '' END AS candidates FROM k""",
)
def sheet_title_roles(spark, sf_dir):
    """The role of a sheet by its title; a title that names more than one kind is left to review with its candidates."""
    title = F.concat_ws(" ", *[F.when(F.floor(F.col("p_partkey") * 7919 / 3**i) % 3 == 0, w) for i, w in enumerate(_TITLE_WORDS)])
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("t")).withColumn("kinds", _found({k: F.expr(v) for k, v in _SHEET_KINDS.items()})).withColumn("k", F.size("kinds"))
    role = F.expr(_SHEET_ROLE)
    return rows.select("p_partkey", F.col("t").alias("title"), role.alias("role"), F.when((role == "review") & (F.col("k") > 1), F.array_join("kinds", ",")).otherwise("").alias("candidates"))


@query(
    "page_gate",
    f"""WITH {PREDICTIONS_SQL}, gated AS (SELECT CAST(s_suppkey AS BIGINT) AS page, CASE WHEN s_suppkey % 10 = 0 THEN 'legend' ELSE 'notes' END AS role FROM supplier WHERE s_suppkey % 5 = 0)
SELECT coalesce(role, 'drawing') AS role, source, count(*) AS n, count(*) FILTER (role IS NULL) AS kept, count(*) FILTER (role IS NOT NULL AND section IS NOT NULL) AS dropped_sections FROM predictions LEFT JOIN gated USING (page) GROUP BY 1, 2""",
)
def page_gate(spark, sf_dir):
    """What a gate on pages of context would drop, as counts."""
    key = F.col("s_suppkey")
    gated = table(spark, sf_dir, "supplier").filter(key % 5 == 0).select(key.cast("long").alias("page"), F.when(key % 10 == 0, "legend").otherwise("notes").alias("gate"))
    rows = predictions(spark, sf_dir).join(gated, "page", "left")
    count = lambda held: F.count(F.when(held, 1))
    gate = F.col("gate")
    return rows.groupBy(F.coalesce("gate", F.lit("drawing")).alias("role"), "source").agg(_n(), count(gate.isNull()).alias("kept"), count(gate.isNotNull() & F.col("section").isNotNull()).alias("dropped_sections"))


_GATES = {
    "token_empty": "section IS NULL", "human_reviewed": "source = 'CORRECTION'", "context_page": "page % 5 = 0", "no_family": "family IS NULL", "already_complete": "source = 'FUSION' AND confidence >= 0.8",
}
_GATE = "CASE " + " ".join(f"WHEN {held} THEN '{name}'" for name, held in _GATES.items()) + " WHEN rules IS NULL THEN 'no_rule' WHEN rules > 1 THEN 'conflicting_rules' ELSE 'applied' END"


@query(
    "rule_gates",
    f"""WITH {PREDICTIONS_SQL}, rules AS (SELECT label AS section, min(p_brand) AS target, count(DISTINCT p_brand) AS rules FROM parts WHERE p_partkey % 3 = 0 GROUP BY label)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_GATE} AS gate, CASE WHEN {_GATE} = 'applied' THEN target END AS target FROM predictions LEFT JOIN rules USING (section)""",
)
def rule_gates(spark, sf_dir):
    """The first gate that stops a project's rule from naming a token, or the name where none does."""
    rules = labelled_parts(spark, sf_dir).filter("p_partkey % 3 = 0").groupBy(F.col("label").alias("section")).agg(F.min("p_brand").alias("target"), F.countDistinct("p_brand").alias("rules"))
    rows = predictions(spark, sf_dir).join(rules, "section", "left").withColumn("gate", F.expr(_GATE))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "gate", F.when(F.col("gate") == "applied", F.col("target")).alias("target"))


_LEVEL_NAME = """CASE {k} % 5 WHEN 0 THEN 'T.O. SLAB LEVEL ' || (1 + {k} % 9) WHEN 1 THEN 'ROOF FRAMING PLAN AREA ' || substr('ABC', CAST(1 + {k} % 3 AS INT), 1) WHEN 2 THEN (1 + {k} % 9) || 'TH FLOOR EAST' WHEN 3 THEN 'LEVEL ' || (1 + {k} % 9) || ' WEST' ELSE 'GENERAL NOTES' END"""
_CUT_LEVEL = " AREA [A-C]"
#: Words of a level's name that tell nothing of the level.
_LEVEL_NOISE = "^(T.O.|TO|TOP|OF|SLAB|FRAMING|PLAN|PLANS|NOTES|OVERALL|PARTIAL|AND|ELEVATION|STRUCTURAL|ENLARGED|FOUNDATION|ROOF|ROOFS|FLOOR|LEVEL|STORY|STOREY|[0-9]+(ST|ND|RD|TH)?)$"


def _level_sql(name: str) -> str:
    cut = f"regexp_replace({name}, '{_CUT_LEVEL}', ' ')"
    ordinal = f"coalesce(TRY_CAST(regexp_extract({cut}, '([0-9]+)(ST|ND|RD|TH)', 1) AS BIGINT), TRY_CAST(regexp_extract({cut}, '(LEVEL|FLOOR) ([0-9]+)', 2) AS BIGINT))"
    kind = f"CASE WHEN regexp_matches({cut}, 'ROOF') THEN 'roof' WHEN regexp_matches({cut}, 'FLOOR|LEVEL|STOR') THEN 'floor' END"
    left = f"array_to_string(list_sort(list_filter(string_split({cut}, ' '), lambda x: x <> '' AND NOT regexp_matches(x, '{_LEVEL_NOISE}'))), ' ')"
    return f"{ordinal} AS ordinal, {kind} AS kind, {left} AS qualifiers"


@query(
    "level_titles",
    f"""WITH a AS (SELECT p_partkey, {_LEVEL_NAME.format(k="p_partkey")} AS name FROM part), l AS (SELECT p_partkey, name, {_level_sql("name")} FROM a), b AS (SELECT s_suppkey AS page, {_LEVEL_NAME.format(k="(s_suppkey + 2)")} AS title FROM supplier), p AS (SELECT page, {_level_sql("title")} FROM b),
k AS (SELECT kind, ordinal, qualifiers, count(*) AS plans, min(page) AS first FROM p WHERE kind IS NOT NULL OR ordinal IS NOT NULL GROUP BY ALL)
SELECT p_partkey, name, l.kind, l.ordinal, l.qualifiers, coalesce(plans, 0) AS plans, first FROM l LEFT JOIN k ON k.kind = l.kind AND k.ordinal IS NOT DISTINCT FROM l.ordinal AND k.qualifiers = l.qualifiers""",
)
def level_titles(spark, sf_dir):
    """Names of levels and titles of plans that share kind, ordinal and qualifiers."""

    def key(rows, name):
        cut = F.regexp_replace(name, _CUT_LEVEL, " ")
        part = lambda pattern, k: F.nullif(F.regexp_extract(cut, pattern, k), F.lit("")).cast("long")
        words = F.array_sort(F.filter(F.split(cut, " "), lambda x: (x != "") & ~x.rlike(_LEVEL_NOISE)))
        kind = F.when(cut.rlike("ROOF"), "roof").when(cut.rlike("FLOOR|LEVEL|STOR"), "floor")
        return rows.withColumn("ordinal", F.coalesce(part("([0-9]+)(ST|ND|RD|TH)", 1), part("(LEVEL|FLOOR) ([0-9]+)", 2))).withColumn("kind", kind).withColumn("qualifiers", F.array_join(words, " "))

    levels = key(table(spark, sf_dir, "part").select("p_partkey", F.expr(_LEVEL_NAME.format(k="p_partkey")).alias("name")), "name")
    titles = key(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.expr(_LEVEL_NAME.format(k="(s_suppkey + 2)")).alias("title")), "title")
    k = titles.filter("kind is not null or ordinal is not null").groupBy(F.col("kind").alias("k"), F.col("ordinal").alias("o"), F.col("qualifiers").alias("q")).agg(F.count(F.lit(1)).alias("plans"), F.min("page").alias("first"))
    met = levels.join(k, (F.col("kind") == F.col("k")) & F.col("ordinal").eqNullSafe(F.col("o")) & (F.col("qualifiers") == F.col("q")), "left")
    return met.select("p_partkey", "name", "kind", "ordinal", "qualifiers", F.coalesce("plans", F.lit(0)).alias("plans"), "first")


_CELL = "label || ', B(' || depth || ',' || weight || '), C' || depth"


@query("location_split", f"WITH {PARTS_SQL}, s AS (SELECT p_partkey, {_CELL} AS cell FROM parts), u AS (SELECT p_partkey, unnest(regexp_extract_all(cell, '(?:[^,(]|\\([^)]*\\))+')) AS place FROM s) SELECT p_partkey, trim(place) AS place FROM u")
def location_split(spark, sf_dir):
    """The places of a cell, split at commas outside of parentheses."""
    cells = labelled_parts(spark, sf_dir).select("p_partkey", F.expr(_CELL).alias("cell"))
    return cells.select("p_partkey", F.explode(F.split("cell", ",(?![^(]*\\))")).alias("place")).select("p_partkey", F.trim("place").alias("place"))


@query(
    "training_frame",
    f"""WITH {PREDICTIONS_SQL}, u AS (SELECT label, printed AS token, 0 AS turn, 'base' AS origin FROM printed UNION ALL SELECT section, section, 1, 'approved' FROM predictions WHERE section IS NOT NULL AND source = 'CORRECTION' AND confidence >= 0.8)
SELECT label, token, arg_min(origin, turn) AS origin, count(*) AS n FROM u GROUP BY label, token""",
)
def training_frame(spark, sf_dir):
    """The base samples and the approved ones, once each, the base first."""
    base = labelled_parts(spark, sf_dir).select("label", F.col("printed").alias("token"), F.lit(0).alias("turn"), F.lit("base").alias("origin"))
    good = predictions(spark, sf_dir).filter("section is not null and source = 'CORRECTION' and confidence >= 0.8")
    both = base.unionByName(good.select(F.col("section").alias("label"), F.col("section").alias("token"), F.lit(1).alias("turn"), F.lit("approved").alias("origin")))
    return both.groupBy("label", "token").agg(F.min_by("origin", "turn").alias("origin"), _n())


@query(
    "sidecar_schema",
    f"""WITH {PARTS_SQL} SELECT family, count(*) AS n, count(*) FILTER (p_partkey % 11 = 0) AS wrong_type, count(*) FILTER (p_partkey % 11 <> 0 AND p_partkey % 13 = 0) AS missing FROM parts GROUP BY family""",
)
def sidecar_schema(spark, sf_dir):
    """Records written beside a result as JSON, read back under a schema: values of another type and missing ones."""
    key = F.col("p_partkey")
    weight = F.when(key % 11 == 0, F.lit('"heavy"')).when(key % 13 != 0, F.col("weight").cast("string"))
    record = F.concat(F.lit('{"family":"'), "family", F.lit('"'), F.coalesce(F.concat(F.lit(',"weight":'), weight), F.lit("")), F.lit("}"))
    path = scratch_path(spark, "sidecar")
    labelled_parts(spark, sf_dir).select(record.alias("value")).write.text(path)
    read = spark.read.schema("family string, weight long, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    broken, lacks = F.col("broken").isNotNull(), F.col("weight").isNull()
    return read.groupBy("family").agg(_n(), F.count(F.when(broken, 1)).alias("wrong_type"), F.count(F.when(~broken & lacks, 1)).alias("missing"))


_ROLE = "CASE page % 4 WHEN 0 THEN 'beam' WHEN 1 THEN 'column' WHEN 2 THEN 'brace' ELSE '' END"
_RERANK = {
    "geo": """least(1.0{d}, 0.35{d} + confidence / 2 + CASE WHEN role = 'beam' AND family IN ('W', 'S', 'M', 'C', 'MC') THEN 0.15{d} WHEN role = 'column' AND family IN ('W', 'HSS', 'PIPE') THEN 0.10{d} ELSE 0.0{d} END + CASE WHEN role = 'brace' AND family IN ('HSS', 'L', '2L', 'WT') THEN 0.12{d} ELSE 0.0{d} END)""",
    "gra": """least(1.0{d}, 0.35{d} + quantity / 100.0{d} + CASE WHEN role = 'beam' AND family IN ('W', 'S', 'M', 'C', 'MC') THEN 0.10{d} ELSE 0.0{d} END) * CASE WHEN quantity < 10 AND role IN ('beam', 'brace') THEN 0.7{d} ELSE 1.0{d} END""",
}
_FINAL = "(0.68{d} * confidence + 0.05{d} * 0.5{d} + CASE WHEN source = 'GEOMETRY' THEN 0.18{d} * geo ELSE 0.0{d} END + CASE WHEN quantity >= 10 THEN 0.09{d} * gra ELSE 0.0{d} END) / (0.73{d} + CASE WHEN source = 'GEOMETRY' THEN 0.18{d} ELSE 0.0{d} END + CASE WHEN quantity >= 10 THEN 0.09{d} ELSE 0.0{d} END)"
_FUSED = "greatest(0.0{d}, least(1.0{d}, 0.72{d} * evidence + 0.20{d} * top + 0.08{d} * greatest(0.0{d}, top - second)))"


@query(
    "rerank_fusion",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, {_ROLE} AS role FROM predictions WHERE section IS NOT NULL), s AS (SELECT *, {", ".join(v.format(d="::DOUBLE") + " AS " + k for k, v in _RERANK.items())} FROM r), f AS (SELECT page, section, max({_FINAL.format(d="::DOUBLE")}) AS score, avg(confidence) AS evidence FROM s GROUP BY page, section),
w AS (SELECT *, score AS top, coalesce(lead(score) OVER w, 0) AS second, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY page ORDER BY score DESC, section)) SELECT page, section, round(top, 6) AS score, round({_FUSED.format(d="::DOUBLE")}, 6) AS confidence FROM w WHERE k = 1""",
)
def rerank_fusion(spark, sf_dir):
    """The first section of a page by text, rules, geometry and graph over the weights at hand, and the confidence of its evidence, score and margin."""
    at = {k: F.expr(v.format(d="D")) for k, v in _RERANK.items()}
    rows = predictions(spark, sf_dir).filter("section is not null").withColumn("role", F.expr(_ROLE)).withColumns(at)
    scored = rows.groupBy("page", "section").agg(F.max(F.expr(_FINAL.format(d="D"))).alias("score"), F.avg("confidence").alias("evidence"))
    w = W.partitionBy("page").orderBy(F.desc("score"), "section")
    w = scored.select("page", "section", "evidence", F.col("score").alias("top"), F.coalesce(F.lead("score").over(w), F.lit(0.0)).alias("second"), F.row_number().over(w).alias("k")).filter("k = 1")
    return w.select("page", "section", F.round("top", 6).alias("score"), F.round(F.expr(_FUSED.format(d="D")), 6).alias("confidence"))


@query(
    "plate_marks",
    f"""WITH {PREDICTIONS_SQL}, rows AS (SELECT l_suppkey AS document, 'BP' || l_partkey % 60 AS mark, section AS plate FROM predictions WHERE is_schedule AND section IS NOT NULL), k AS (SELECT document, mark, min(plate) AS plate, count(DISTINCT plate) AS plates, count(*) AS n FROM rows GROUP BY 1, 2),
u AS (SELECT l_suppkey AS document, 'BP' || l_partkey % 60 AS mark, count(*) AS used FROM predictions WHERE NOT is_schedule GROUP BY 1, 2)
SELECT document, mark, used, CASE WHEN n = 1 OR plates = 1 THEN plate END AS plate, CASE WHEN plates IS NULL THEN 'absent' WHEN plates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM u LEFT JOIN k USING (document, mark)""",
)
def plate_marks(spark, sf_dir):
    """Plate marks of a document through all its schedules; several different plates leave the mark open."""
    rows = predictions(spark, sf_dir).select(F.col("l_suppkey").alias("document"), F.concat(F.lit("BP"), (F.col("l_partkey") % 60).cast("string")).alias("mark"), "section", "is_schedule")
    plates = rows.filter("is_schedule and section is not null").groupBy("document", "mark").agg(F.min("section").alias("plate"), F.countDistinct("section").alias("plates"))
    used = rows.filter("not is_schedule").groupBy("document", "mark").agg(F.count(F.lit(1)).alias("used"))
    one = F.col("plates") == 1
    status = F.when(F.col("plates").isNull(), "absent").when(one, "resolved").otherwise("ambiguous")
    return used.join(plates, ["document", "mark"], "left").select("document", "mark", "used", F.when(one, F.col("plate")).alias("plate"), status.alias("status"))


@query(
    "level_agreement",
    """WITH l AS (SELECT l_suppkey AS page, l_partkey % 6 AS level, CAST(round(avg(l_quantity) * 4) AS BIGINT) AS noted FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), s AS (SELECT l_suppkey AS page, l_partkey % 6 AS level, CAST(round(avg(l_quantity) * 4) AS BIGINT) AS scheduled FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2)
SELECT page, level, noted, scheduled, scheduled - noted AS difference, CASE WHEN noted IS NULL THEN 'schedule_only' WHEN scheduled IS NULL THEN 'note_only' WHEN abs(scheduled - noted) <= 1 THEN 'agree' ELSE 'conflict' END AS status FROM l FULL JOIN s USING (page, level)""",
)
def level_agreement(spark, sf_dir):
    """A level's height by the plan's notes and by the schedule: agreement within an inch, conflict, or one source alone."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 6).alias("level"), "l_linenumber", "l_quantity")
    mean = lambda rows, name: rows.groupBy("page", "level").agg(F.round(F.avg("l_quantity") * 4).cast("long").alias(name))
    both = mean(items.filter("l_linenumber <= 3"), "noted").join(mean(items.filter("l_linenumber > 3"), "scheduled"), ["page", "level"], "full")
    gap = F.col("scheduled") - F.col("noted")
    status = F.when(F.col("noted").isNull(), "schedule_only").when(F.col("scheduled").isNull(), "note_only").when(F.abs(gap) <= 1, "agree").otherwise("conflict")
    return both.select("page", "level", "noted", "scheduled", gap.alias("difference"), status.alias("status"))


@query(
    "batch_review",
    f"""WITH {PARTS_SQL}, k AS (SELECT user_id, ts, min(event_id) AS first FROM events GROUP BY ALL) SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 'invalid_value' WHEN event_id <> first THEN 'duplicate_item' WHEN label IS NULL THEN 'unknown_object' END AS error, CASE WHEN value > 0 AND event_id = first THEN label END AS label
  FROM events LEFT JOIN k USING (user_id, ts) LEFT JOIN parts ON p_partkey = event_id % 3000""",
)
def batch_review(spark, sf_dir):
    """Reviews applied in one batch: each row's label, or the first error that keeps it out."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", (F.col("event_id") % 3000).alias("p_partkey"))
    first = events.groupBy("user_id", "ts").agg(F.min("event_id").alias("first"))
    met = events.join(first, ["user_id", "ts"], "left").join(labelled_parts(spark, sf_dir).select("p_partkey", "label"), "p_partkey", "left")
    c = F.col
    error = F.when(c("value").isNull() | (c("value") <= 0), "invalid_value").when(c("event_id") != c("first"), "duplicate_item").when(c("label").isNull(), "unknown_object")
    return met.select("event_id", error.alias("error"), F.when((c("value") > 0) & (c("event_id") == c("first")), c("label")).alias("label"))


@query(
    "modality_union",
    f"""WITH {PREDICTIONS_SQL}, u AS (SELECT 'text' AS modality, printed AS sample, label, 0 AS source FROM printed UNION ALL SELECT 'geometry', section, section, 1 FROM predictions WHERE source = 'GEOMETRY' AND section IS NOT NULL UNION ALL SELECT 'text', section, section, 2 FROM predictions WHERE source = 'CORRECTION' AND section IS NOT NULL),
d AS (SELECT modality, sample, label, min(source) AS source, count(*) AS n FROM u GROUP BY 1, 2, 3) SELECT modality, source, count(*) AS samples, CAST(sum(n) AS BIGINT) AS rows FROM d GROUP BY 1, 2""",
)
def modality_union(spark, sf_dir):
    """All sources' samples, once each within their modality; the first source keeps a sample."""
    rows = predictions(spark, sf_dir).filter("section is not null")
    of = lambda name, modality, turn: rows.filter(F.col("source") == name).select(F.lit(modality).alias("modality"), F.col("section").alias("sample"), F.col("section").alias("label"), F.lit(turn).alias("source"))
    base = labelled_parts(spark, sf_dir).select(F.lit("text").alias("modality"), F.col("printed").alias("sample"), "label", F.lit(0).alias("source"))
    once = base.unionByName(of("GEOMETRY", "geometry", 1)).unionByName(of("CORRECTION", "text", 2)).groupBy("modality", "sample", "label").agg(F.min("source").alias("source"), _n())
    return once.groupBy("modality", "source").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("rows"))


@query(
    "reference_edges",
    f"""WITH n AS (SELECT l_orderkey AS sheet, {_NOTE} AS raw FROM lineitem), r AS (SELECT DISTINCT sheet, 'S' || regexp_replace(regexp_extract(raw, '{_SHEET}', 1), '[^0-9]', '', 'g') AS ref FROM n WHERE regexp_matches(raw, '{_SHEET}')), h AS (SELECT *, min(sheet) OVER (PARTITION BY ref) AS hub FROM r)
SELECT hub, sheet, list_sort(list(ref)) AS shared FROM h WHERE sheet <> hub GROUP BY hub, sheet""",
)
def reference_edges(spark, sf_dir):
    """Sheets that share a drawing reference, each tied to the first that names it: the components of all pairs, in linear size."""
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.expr(_NOTE).alias("raw")).filter(F.col("raw").rlike(_SHEET))
    refs = notes.select("sheet", F.concat(F.lit("S"), F.regexp_replace(F.regexp_extract("raw", _SHEET, 1), "[^0-9]", "")).alias("ref")).distinct()
    hubs = refs.groupBy("ref").agg(F.min("sheet").alias("hub"))
    return refs.join(hubs, "ref").filter("sheet <> hub").groupBy("hub", "sheet").agg(F.sort_array(F.collect_set("ref")).alias("shared"))


@query(
    "pair_discovery",
    """WITH d AS (SELECT 'plan_' || (s_suppkey % 700) AS stem, CAST(s_suppkey AS BIGINT) AS drawing FROM supplier), w AS (SELECT 'plan_' || (c_custkey % 900) AS stem, c_custkey AS workbook FROM customer), a AS (SELECT stem, min(drawing) AS drawing, count(*) AS drawings FROM d GROUP BY stem), b AS (SELECT stem, min(workbook) AS workbook, count(*) AS workbooks FROM w GROUP BY stem)
SELECT stem, drawing, workbook, CASE WHEN drawing IS NULL THEN 'no_drawing' WHEN workbook IS NULL THEN 'no_workbook' WHEN drawings > 1 THEN 'several' ELSE 'paired' END AS status FROM a FULL JOIN b USING (stem)""",
)
def pair_discovery(spark, sf_dir):
    """Drawings and workbooks of one file stem as training pairs, and what has no partner or several."""
    stem = lambda c, n: F.concat(F.lit("plan_"), (F.col(c) % n).cast("string")).alias("stem")
    a = table(spark, sf_dir, "supplier").groupBy(stem("s_suppkey", 700)).agg(F.min(F.col("s_suppkey").cast("long")).alias("drawing"), F.count(F.lit(1)).alias("drawings"))
    b = table(spark, sf_dir, "customer").groupBy(stem("c_custkey", 900)).agg(F.min("c_custkey").alias("workbook"))
    status = F.when(F.col("drawing").isNull(), "no_drawing").when(F.col("workbook").isNull(), "no_workbook").when(F.col("drawings") > 1, "several").otherwise("paired")
    return a.join(b, "stem", "full").select("stem", "drawing", "workbook", status.alias("status"))
