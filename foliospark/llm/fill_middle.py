"""Fill-in-the-middle: documents cut at two units and put together in another order. DataFrame functions only.

A unit is a word of the letters A to Z, or any other single character. Units are rows: matches are exploded with their
places, a window adds up their lengths, requests for cuts meet them by ordinal, and a document's offsets are gathered from
there. So that no document makes a row for each of its units, runs of RUN units are rows first; only the run that a request
falls into is exploded further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import read_table

UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Units of a run.
RUN = 128
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents, so many are transformed; of 100 transformed ones, so many begin with their suffix.
RATE, SUFFIX_FIRST = 90, 20

#: A row's identity: two hashes of its id and text, 128 bits. Rows with one identity are equal.
_KEY = ["__k1", "__k2"]


def unit_count(text) -> F.Column:
    """Units of a text (long), without making them."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "x")).cast("long")


def _drawn(digest, which: int) -> F.Column:
    return F.conv(F.substring(digest, 1 + 8 * which, 8), 16, 10).cast("long")


def _requests(docs: DataFrame, doc_id: str, text: str, seed: int, rate: int, suffix_first: int) -> DataFrame:
    """docs with _KEY, __text, __n, __form, and the ordinals __first <= __second of the units before which a text is cut."""
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), "UTF-8"), 256)
    named = docs.withColumns({"__text": whole, "__digest": digest})
    identity = [F.col(doc_id).isNotNull(), F.col(doc_id), F.col("__text")]
    keyed = named.withColumns({"__k1": F.xxhash64(*identity), "__k2": F.xxhash64(F.lit(1), *identity), "__n": unit_count(F.col("__text"))})
    h = [_drawn(F.col("__digest"), k) for k in range(4)]
    marked = F.contains(F.col("__text"), F.lit(PREFIX)) | F.contains(F.col("__text"), F.lit(SUFFIX)) | F.contains(F.col("__text"), F.lit(MIDDLE))
    form = F.when((F.col("__text") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [h[k] % (F.col("__n") + 1) for k in (0, 1)]
    return keyed.withColumns({"__form": form, "__first": F.least(*cuts), "__second": F.greatest(*cuts)}).drop("__digest")


def _offsets(asked: DataFrame) -> DataFrame:
    """_KEY, __first_at, __second_at: characters before the units that a transformed text is cut at; null at its end.

    Equal rows are merged by their key, so the running sums count each unit once. All steps but the first work on rows dealt out
    by their key once.
    """
    runs = asked.where("__form <> 'plain'").select(*_KEY, "__first", "__second", F.posexplode(F.regexp_extract_all("__text", F.lit(f"(?:{UNIT}){{1,{RUN}}}+"), F.lit(0))).alias("run", "units"))
    wanted = F.when((F.col("run") == F.floor(F.col("__first") / RUN)) | (F.col("run") == F.floor(F.col("__second") / RUN)), F.col("units"))
    here = wanted.isNotNull()
    lengths = runs.select(*_KEY, "run", F.length("units").alias("chars"), wanted.alias("units"), F.when(here, F.col("__first")).alias("__first"), F.when(here, F.col("__second")).alias("__second"))
    once = lengths.repartition(*_KEY).groupBy(*_KEY, "run").agg(F.max("chars").alias("chars"), F.max("units").alias("units"), F.max("__first").alias("__first"), F.max("__second").alias("__second"))
    earlier = Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begun = once.withColumn("before", F.coalesce(F.sum("chars").over(earlier), F.lit(0))).where("units is not null")
    each = begun.select(*_KEY, "__first", "__second", "run", "before", F.posexplode(F.regexp_extract_all("units", F.lit(UNIT), F.lit(0))).alias("place", "unit"))
    in_run = Window.partitionBy(*_KEY, "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.select(*_KEY, "__first", "__second", (F.col("run") * F.lit(RUN) + F.col("place")).alias("ordinal"), (F.col("before") + F.coalesce(F.sum(F.length("unit")).over(in_run), F.lit(0))).alias("at"))
    met = placed.where((F.col("ordinal") == F.col("__first")) | (F.col("ordinal") == F.col("__second")))
    return met.groupBy(*_KEY).agg(F.max(F.when(F.col("ordinal") == F.col("__first"), F.col("at"))).alias("__first_at"), F.max(F.when(F.col("ordinal") == F.col("__second"), F.col("at"))).alias("__second_at"))


def fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (characters as code points, null if plain) and output.

    Form is plain, the text as it is, for an empty text, one that contains a marker, and a share of all others; else psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind its marker. What a document gets follows
    from its id alone. A null text counts as empty; a null id draws like the id "". All rows stay, repeated ones too, and
    get equal outputs; columns named like a new one are replaced. An empty table gives an empty table. The join by row moves
    each text once; of the units only lengths move, and the runs that are cut.
    """
    asked = _requests(docs, doc_id, text, seed, rate, suffix_first)
    whole = F.col("__text")
    found = asked.join(_offsets(asked), _KEY, "left")
    first, second = (F.coalesce(F.col(c), F.length(whole)).cast("long") for c in ("__first_at", "__second_at"))
    cut = found.withColumns({"__first_at": first, "__second_at": second})
    prefix = F.substring(whole, F.lit(1), F.col("__first_at").cast("int"))
    middle = F.substring(whole, (F.col("__first_at") + 1).cast("int"), (F.col("__second_at") - F.col("__first_at")).cast("int"))
    suffix = F.substring(whole, (F.col("__second_at") + 1).cast("int"), F.length(whole))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(whole)
    plain = F.col("__form") == "plain"
    new = {"n": F.col("__n"), "form": F.col("__form"), "prefix_chars": F.when(~plain, F.col("__first_at")), "middle_chars": F.when(~plain, F.col("__second_at") - F.col("__first_at")), "output": output}
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made from. No text that has been cut contains a marker, so the first of each is the cut's."""
    out = F.col(output)
    rest = lambda value, part: F.substring(value, F.length(part) + 4, F.length(value))  # noqa: E731  behind a part and its marker of three
    body = F.substring(out, F.lit(4), F.length(out))
    one = lambda marker: F.substring_index(body, marker, 1)
    two = lambda marker: F.substring_index(rest(body, one(marker)), MIDDLE, 1)
    three = lambda marker: rest(rest(body, one(marker)), two(marker))
    # psm: prefix, suffix, middle; spm: suffix, prefix, middle
    psm = F.concat(one(SUFFIX), three(SUFFIX), two(SUFFIX))
    spm = F.concat(two(PREFIX), three(PREFIX), one(PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every whole document."""
    done = fill_middle(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


SQL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n,
         ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
         ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
  FROM units
), cut AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
