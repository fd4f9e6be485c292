"""Line dedup with a log-template tree, in DataFrame operations only.

Every line gets its place in a tree of fixed depth: number of tokens, then the leading tokens,
where tokens with digits are variable fields (``<*>``). A leaf holds any number of templates. The
first has at each position the token most of the leaf's distinct lines have, and the lines that
agree with it in at least ``similarity`` of the positions belong to it. The others form families
by the tokens that they share with enough of each other (``_families``); a line of no family is a
template of its own. Templates that recur across documents
are dropped everywhere but at their first place (smallest document id, then line), so the
content itself stays in the corpus once.

Only leaves with several different lines are opened up into tokens. All counting is by
aggregates that combine on the map side, and lines meet their template's count in a join that
Spark can split, so a line that a third of all documents share gathers nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postkit.llm.common import set_apart
from postkit.session import materialize

FIELD = "<*>"


def with_normal_form(df: DataFrame, line: str) -> DataFrame:
    """Replaces the column ``line`` by ``normal``: white space made single spaces and tokens with
    digits made variable fields, unless that leaves no more constant tokens than fields. Each
    step is a column of its own, so that no pattern is matched twice."""
    spaced = F.when(F.col(line).rlike("[\\t\\f\\r\\x0B]|  "), F.regexp_replace(line, "[ \\t\\f\\r\\x0B]+", " ")).otherwise(F.col(line))
    plain = df.withColumn("plain", F.trim(spaced)).drop(line)
    # Most lines hold no digit and are done; a field's pattern starts at a token's start, so each token is read once.
    masked = plain.withColumn("masked", F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", "(?<![^ ])[^ 0-9]*[0-9][^ ]*", FIELD)))
    fields = (F.length("masked") - F.length(F.replace("masked", F.lit(FIELD), F.lit("")))) / len(FIELD)
    return masked.withColumn("normal", F.when(fields * 2 < token_count(F.col("masked")), F.col("masked")).otherwise(F.col("plain"))).drop("plain", "masked")


def token_count(normal: Column) -> Column:
    return F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1


def _different(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``text``: every document once, however often its row is
    repeated. Only texts of repeated rows are grouped, after a reduction on the map side."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    again = rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    again = materialize(again, "repeated")
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    return rows.join(again, same, "left_anti").unionByName(
        rows.join(again, same, "left_semi").groupBy("id", "th").agg(F.first("text").alias("text")))


def _occurrences(docs: DataFrame, depth: int) -> DataFrame:
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = with_normal_form(lines, "line").withColumn("n_tokens", F.when(F.col("normal") == "", F.lit(0)).otherwise(token_count(F.col("normal"))))
    return lines.select("id", "th", "line_no", "n_tokens", F.xxhash64("n_tokens", F.substring_index("normal", " ", depth)).alias("leaf"),
                        F.struct(F.xxhash64("normal").alias("a"), F.hash("normal", F.lit(17)).alias("b")).alias("lh"))


def _open_lines(docs: DataFrame, occ: DataFrame) -> DataFrame:
    """``leaf``, ``lh``, ``normal`` of every different line of the leaves that have several: one
    place of each is picked among the hashes, and only there the text is read again."""
    leaves = occ.groupBy("leaf").agg(F.min("lh").alias("low"), F.max("lh").alias("high")).where("low <> high").select("leaf")
    leaves = materialize(leaves, "open-leaves")             # so that the join's own exchange can be split where it is uneven
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "line_no")
    picked = (occ.join(leaves, "leaf", "left_semi").groupBy("leaf", "lh").agg(F.min(place).alias("p"))
              .groupBy(F.col("p.id").alias("__id"), F.col("p.th").alias("__th")).agg(F.collect_list(F.struct("p.line_no", "leaf", "lh")).alias("wanted")))
    found = docs.join(picked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("wanted", F.split("text", "\n").alias("lines"))
    lines = found.select(F.inline(F.transform("wanted", lambda w: F.struct(w["leaf"].alias("leaf"), w["lh"].alias("lh"), F.col("lines")[w["line_no"]].alias("line")))))
    return with_normal_form(lines, "line").groupBy("leaf", "lh").agg(F.first("normal").alias("normal"))


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similarity: float = 0.8) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``line_no``, ``n_tokens`` and ``template`` of every line,
    once for repeated rows. Blank lines have 0 tokens and no template."""
    docs = _different(docs, id_col, text_col)
    occ = materialize(_occurrences(docs, depth), "lines")
    open_lines = materialize(_open_lines(docs, occ), "open-lines").withColumn("tokens", F.split("normal", " "))
    votes = (open_lines.select("leaf", F.posexplode("tokens").alias("pos", "token"))
             .groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("n")))
    leaf_template = (votes.groupBy("leaf", "pos").agg(F.min(F.struct(-F.col("n"), "token")).alias("m"))
                     .groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m.token"))), lambda x: x["token"]).alias("common")))
    agree = F.aggregate(F.zip_with("tokens", "common", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    judged = materialize(open_lines.join(leaf_template, "leaf").select("leaf", "lh", "tokens", (agree >= similarity * F.size("tokens")).alias("joins")), "judged-lines")
    first = judged.where("joins").select("lh", F.struct(F.col("leaf").alias("a"), F.lit(None).cast("int").alias("b")).alias("family"))
    member = materialize(first.unionByName(_families(judged.where("not joins"), similarity)), "template-lines")
    named = occ.join(member, "lh", "left")
    template = F.when(F.col("n_tokens") > 0, F.coalesce("family", "lh"))
    return named.select("id", "th", "line_no", "n_tokens", template.alias("template"))


def _families(lines: DataFrame, similarity: float) -> DataFrame:
    """Further templates of the leaves, for the lines outside their first one: any number of families at once.

    Every token has a support, the number of these lines of its leaf with that token at that position. A line's own support is the
    largest number that at least ``similarity`` of its tokens reach; these tokens stay, the others become variable fields.
    Lines of a leaf with the same result are a family; one that no other line shares is none."""
    tokens = lines.select("leaf", "lh", F.posexplode("tokens").alias("pos", "token"))
    votes = tokens.groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = tokens.join(votes, ["leaf", "pos", "token"]).groupBy("leaf", "lh").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "n"))).alias("held"))
    held = held.join(lines.select("lh", F.size("tokens").alias("size")), "lh")
    least = F.ceil(F.lit(similarity) * F.col("size")).cast("int")
    own = F.reverse(F.sort_array(F.transform("held", lambda x: x["n"])))[least - 1]
    kept = held.where(F.size("held") >= least).withColumn("own", own)
    form = F.concat_ws(" ", F.transform(F.filter("held", lambda x: x["n"] >= F.col("own")), lambda x: F.concat(x["pos"].cast("string"), F.lit(" "), x["token"])))
    formed = kept.select("lh", F.struct(F.xxhash64("leaf", F.lit(FIELD), form).alias("a"), F.hash(form, F.lit(29)).alias("b")).alias("family"))
    shared = formed.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family")
    return formed.join(shared, "family", "left_semi").select("lh", "family")


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, similarity: float = 0.8,
               min_docs: int = 2, short_tokens: int = 0, short_docs: int = 10) -> DataFrame:
    """One row per document: ``id``, ``th`` and ``lines``, an array of (line_no, dropped)."""
    lines = materialize(line_templates(docs, id_col, text_col, depth, similarity), "line-templates")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "line_no")
    per_doc = lines.where(F.col("template").isNotNull()).groupBy("template", "id", "th").agg(
        F.min("line_no").alias("line_no"), F.min("n_tokens").alias("n_tokens"))
    recurring = (per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"), F.min("n_tokens").alias("n"))
                 .where(F.col("n_docs") >= F.when(F.col("n") < short_tokens, F.lit(max(short_docs, min_docs))).otherwise(F.lit(min_docs)))
                 .select("template", "first"))
    recurring = materialize(recurring, "recurring")         # so that the join's own exchange can be split where it is uneven
    dropped = F.col("first").isNotNull() & (place != F.col("first"))
    return (lines.join(recurring, "template", "left")
            .groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("line_no", F.coalesce(dropped, F.lit(False)).alias("dropped")))).alias("lines")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "", **options) -> DataFrame:
    """All columns of ``docs``, the text without its recurring lines, and ``n_lines`` and
    ``n_dropped`` under ``prefix`` (they replace columns of the same names); one row per row.

    Lines are dropped from ``min_docs`` documents on. With ``short_tokens`` (off by default) lines of fewer tokens are dropped
    only if at least ``short_docs`` documents have them. Blank lines stay. A null text stays
    null with 0 lines, an empty text has one blank line. Rows with the same id and text are one
    document, and each of them gets the same result; a null id comes after all ids. Texts that
    lose all their lines become empty. An empty table gives no rows. Other columns may have any name.
    """
    names = [f"{prefix}n_lines", f"{prefix}n_dropped"]
    return set_apart(docs, [id_col, text_col, *names], lambda df: _dedup_lines(df, id_col, text_col, names, options))


def _dedup_lines(docs: DataFrame, id_col: str, text_col: str, names: list[str], options: dict) -> DataFrame:
    marks = mark_lines(docs, id_col, text_col, **options).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("lines").alias("__lines"))
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.col("__lines")[i]["dropped"]), "\n")
    n_dropped = F.size(F.filter("__lines", lambda x: x["dropped"])).cast("long")
    none = F.col("__lines").isNull()
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    columns = [F.when(none | (n_dropped == 0), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c)
               for c in docs.columns if c not in names]
    return joined.select(*columns, F.when(none, F.lit(0)).otherwise(F.size("__lines")).cast("long").alias(names[0]),
                         F.when(none, F.lit(0)).otherwise(n_dropped).cast("long").alias(names[1]))
