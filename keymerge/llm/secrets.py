"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

DataFrame operations and ``pyspark.ml`` only: patterns cut candidates out of
whole texts, columns describe each (its length, character transitions, how much
of it dictionary words cover, its path and the words beside it), and a forest
trained from labelled findings keeps the likely ones.

``label_by_rule`` labels the findings whose kind is beyond doubt (formats that
providers publish, values assigned to a password; numbers, addresses and plain
words on the other side).  Reviewers' labels can be given instead.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_side, stored, unclashed

#: Findings that the forest is trained on at most (the documented bound), its trees, and the probability kept.
TRAIN_ROWS, TREES, DEPTH, THRESHOLD = 20_000, 20, 6, 0.5
#: Code points beside a candidate that count as its neighbourhood.
BESIDE = 40

# Names that announce a secret, published key formats, common words, words for harmless codes.
CUES = "passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?"
FORMATS = (r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
           r"|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
WORDS = ("about after again all also and any are because been but can con contra could day das dans del der des die for from "
         "good great have here into its just know like look make more most muy not now one only other our out over para pas people "
         "por pour que see some sur than that the their them then there these they this time two und une use von was way "
         "well what when which who will with word work would year you your")
HARMLESS = "commit|sha-?1|sha-?256|md5|hash|checksum|digest|uuid|guid|version|revision|build|order|invoice|isbn|phone|card|serial|example|sample|dummy"

_RUN = r"[A-Za-z0-9+/_-]"
# A cue and ':', '=', ':=', '=>', '==' or the like; a quoted value runs up to its closing quote (possessive: Java
# repeats such groups without recursion), another one, or one whose quote is not closed on its line, to a blank, ',' or ';'.
_ASSIGN = rf"(?i:(?:{CUES})[\"']?[ \t]*+(?::=?+|={{1,3}}+>?+)[ \t]*+)"
_ASSIGNED = (rf"{_ASSIGN}(?:\"(?:[^\"\\\r\n]|\\[^\r\n]){{6,}}+(?=\")|'(?:[^'\\\r\n]|\\[^\r\n]){{6,}}+(?=')"
             rf"|[\"']?[^\s\"',;]{{6,}}+)")
_HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_MIXED = rf"(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{12,}}+=*+"
_CAPITALS = rf"(?<!{_RUN})[A-Z]{{16,}}+(?!{_RUN})"
# Letters of both cases, more than one word with a first capital.
_LETTERS = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z][a-z]*+[A-Z])(?=[A-Z]*+[a-z])[A-Za-z]{16,}+(?![A-Za-z0-9+/_-])"
_CANDIDATE = f"{_ASSIGNED}|{_HEADER}|{_MIXED}|{_CAPITALS}|{_LETTERS}"

FEATURES = ("length", "digits", "capitals", "marks", "distinct", "changes", "vowel_changes", "longest_same", "coverage",
            "path_test", "path_code", "cue", "assigned", "quoted", "harmless", "at_sign", "dotted")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: ``doc_id, text_hash, path, start, end, candidate, before, after, assigned``.

    Offsets are code points, the end exclusive; an assigned value stands without its name.
    Null and empty texts have none; repeated rows give theirs each; texts are read whole.
    """
    d = pick(docs, doc_id=id_col, text=text_col, path=path_col).withColumn("found", F.regexp_extract_all("text", F.lit(_CANDIDATE), 0))
    d = d.filter(F.size("found") > 0).withColumn("between", F.split("text", _CANDIDATE, -1))
    # Where each match begins: what stands between the matches and the matches, added up.
    steps = F.zip_with(F.slice("between", F.lit(1), F.size("found")), "found", lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(steps, zero, lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["len"]).alias("at"), F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts")))["starts"]
    d = d.withColumn("m", F.explode(F.arrays_zip(starts.alias("start"), F.col("found").alias("match"))))
    value = F.regexp_extract("m.match", rf"(?s)^{_ASSIGN}[\"']?(.*)$", 1)
    d = d.withColumn("assigned", value != "").withColumn("candidate", F.when(F.col("assigned"), value).otherwise(F.col("m.match")))
    end = F.col("m.start") + F.length("m.match")
    start = end - F.length("candidate")
    return d.select("doc_id", F.xxhash64("text").alias("text_hash"), "path", start.cast("long").alias("start"), end.cast("long").alias("end"), "candidate",
                    F.substring(F.col("text"), F.greatest(start - BESIDE, F.lit(0)) + 1, F.least(start, F.lit(BESIDE))).alias("before"),
                    F.substring(F.col("text"), end + 1, F.lit(BESIDE)).alias("after"), "assigned")


def _share(pattern: str) -> Column:
    """The part of the candidate's characters that the pattern matches."""
    c = F.col("candidate")
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)


def _changes(*classes: str) -> Column:
    """The part of neighbouring characters that differ in class."""
    c = F.col("candidate")
    for i, p in enumerate(classes):
        c = F.regexp_replace(c, p, chr(1 + i))
    # Every run of one class shrinks to one character: what is left, less one, are the changes.
    return (F.length(F.regexp_replace(c, r"([\x01-\x08])\1++", "$1")) - 1) / F.greatest(F.length("candidate") - 1, F.lit(1))


def describe(found: DataFrame) -> DataFrame:
    """``found`` with the columns ``FEATURES``."""
    c, path = F.col("candidate"), F.lower(F.coalesce("path", F.lit("")))
    words = "|".join(sorted((w for w in WORDS.split() if len(w) > 2), key=lambda w: (-len(w), w)))
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), 0), F.length))
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    columns = {
        "length": F.log1p(F.length(c)), "digits": _share("[0-9]"), "capitals": _share("[A-Z]"), "marks": _share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.transform(F.split(c, ""), F.ascii))) / F.length(c),  # as numbers: in linear time
        "changes": _changes("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9\\x01-\\x03]"),
        "vowel_changes": _changes("[aeiouAEIOU]", "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]", "[^a-zA-Z\\x01\\x02]"),
        "longest_same": F.coalesce(longest, F.lit(0)) / F.length(c),
        "coverage": _share(f"(?i)(?:{words})"),
        "path_test": yes(path.rlike("test|example|fixture|mock|doc")), "path_code": yes(path.rlike(r"\.(py|js|ts|go|rs|java|rb|sh|env|ya?ml|json|toml|cfg|ini)$")),
        "cue": yes(F.col("before").rlike(f"(?i)(?:{CUES})")), "assigned": yes(F.col("assigned")),
        "quoted": yes(F.col("before").rlike("[\"'`]$")), "harmless": yes(F.col("before").rlike(f"(?i)(?:{HARMLESS})")),
        "at_sign": yes(F.col("after").startswith("@") | F.col("before").rlike("@[^\\s]*$")), "dotted": yes(F.col("before").endswith(".") | F.col("after").rlike("^\\.[A-Za-z0-9]")),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def _published() -> Column:
    return F.col("candidate").rlike(f"^(?:{FORMATS})$")


def _strong() -> Column:
    """Whether a finding is a secret beyond doubt."""
    c = F.col("candidate")
    return _published() | (F.col("assigned") & c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.length(c) >= 8) & ~c.rlike("\\s"))


def label_by_rule(found: DataFrame) -> DataFrame:
    """Labels (1.0 secret, 0.0 not) for the findings beyond doubt; the others are left out."""
    c = F.col("candidate")
    # Letters of both cases alone may be a key: only words joined by capitals are harmless beyond doubt.
    words = c.rlike("^(?:[A-Z]?[a-z]{2,})+$") | ~(c.rlike("[a-z]") & c.rlike("[A-Z]"))
    harmless = ~F.col("assigned") & (c.rlike("^[0-9+/_=-]+$") | (~c.rlike("[0-9]") & words) | F.col("after").startswith("@") | F.col("before").rlike("(?i)https?://\\S*$"))
    return found.withColumn("label", F.when(_strong(), 1.0).when(harmless, 0.0)).filter(F.col("label").isNotNull())


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (columns of ``candidates`` and ``label``): of each kind at most
    half of ``rows``, the lowest by hash, and both kinds weigh the same.  None if there are not both
    kinds: nothing could be learned."""
    order = (F.xxhash64("doc_id", "start", "candidate"), "doc_id", "start", "candidate")
    kinds = [labelled.filter(F.col("label") == k).orderBy(*order).limit(rows // 2) for k in (0.0, 1.0)]
    sample = stored(describe(kinds[0].unionByName(kinds[1])).select("label", *FEATURES), "findings")
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    weight = F.when(F.col("label") == 1.0, F.lit(0.5 / n[1.0])).otherwise(F.lit(0.5 / n[0.0])) * sum(n.values())
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=9, featuresCol="features", labelCol="label", weightCol="weight")
    return forest.fit(_vectors(sample.withColumn("weight", weight)))


def _vectors(described: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)


def judge(found: DataFrame, model: RandomForestClassificationModel | PipelineModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with ``score`` and ``secret``; without a model those count as secrets that the rule labels so."""
    if model is None:
        return found.withColumn("score", F.when(_strong(), 1.0).otherwise(0.0)).withColumn("secret", _strong())
    keep = found.columns
    scored = model.transform(_vectors(describe(found.withColumn("was_assigned", F.col("assigned")))))
    scored = scored.withColumn("assigned", F.col("was_assigned"))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*keep, score.alias("score"), (score >= threshold).alias("secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, **cols: str) -> DataFrame:
    """Findings of every whole text, with the forest's verdict; one row per candidate.

    * Null and empty texts have no findings; an empty table gives none.
    * A null path counts as an empty one; repeated rows are scanned each.
    * Without reviewers' labels a published key format is a secret whatever the forest says.
    * Overlapping candidates do not occur: a text is cut from left to right.
    * Other columns are ignored.
    """
    found = stored(candidates(docs, **cols), "candidates")
    if labelled is not None:
        return judge(found, train(labelled))
    judged = judge(found, train(label_by_rule(found)))
    return judged.withColumns({"score": F.when(_published(), 1.0).otherwise(F.col("score")), "secret": F.col("secret") | _published()})


def digest(findings: DataFrame) -> DataFrame:
    """Findings without the secrets themselves."""
    return findings.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "assigned", "score", "secret")


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mask``; all rows and columns stay.

    A finding belongs to the rows of its id and text.  The findings of a document come
    together in one row: they are fewer than its characters.  Null and empty texts stay as they
    are; rows without an id get the findings of rows without one and of their text; repeated rows
    are masked each; other columns pass through, also such with clashing names; an empty table gives no rows.
    """
    docs, restore = unclashed(docs, id_col, text_col)
    spans = findings.filter("secret").select("doc_id", "text_hash", F.struct("start", "end").alias("span")).distinct()
    spans = small_side(stored(spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.sort_array(F.collect_list("span")).alias("_spans")), "spans"))
    text = F.col(text_col)
    cut = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out")))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h")), "left").withColumn("_cut", cut)
    whole = F.concat(F.col("_cut.out"), F.substring(text, F.col("_cut.at").cast("int") + 1, F.length(text)))
    return restore(joined.withColumn(text_col, F.when(F.col("_cut").isNotNull(), whole).otherwise(text)))
