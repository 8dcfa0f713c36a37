"""One query per operator over whole tables, under the names the entry module registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitframe.llm.common import part_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels without the held-out fifth."""
    return table(spark, sf_dir, "labels").where(part_of("doc_id", 5) != 0)


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import langid

    docs = _documents(spark, sf_dir)
    held = part_of("doc_id", 3) == 1
    model = langid.fit(docs.where(~held & F.col("lang").isNotNull()))
    return langid.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import quality

    model = quality.fit(_documents(spark, sf_dir), _labels(spark, sf_dir))
    rows = quality.score(_documents(spark, sf_dir), model, {"doc_id": F.col("doc_id"), "held_out": part_of("doc_id", 5) == 0})
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import toxicity

    model = toxicity.fit(_documents(spark, sf_dir), _labels(spark, sf_dir))
    rows = toxicity.score(_documents(spark, sf_dir), model, {"doc_id": F.col("doc_id"), "held_out": part_of("doc_id", 5) == 0})
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_decontamination", """
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w
    from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w
    from benchmark
), bl as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
grams as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as gram from (select *, unnest(generate_series(1, len(w) - n + 1)) as s from bl)),
sizes as (select distinct n from grams),
windows as (
    select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as gram
    from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, sizes where len(w) >= n)
), hits as (select doc_id, windows.n, s, item_id from windows join grams using (n, gram)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm.decontaminate import contamination

    return contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op4_vectors")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import tokens

    return tokens.suffix_sums(tokens.length_histogram(_documents(spark, sf_dir)))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import pii

    return pii.find(_documents(spark, sf_dir), {"doc_id": F.col("doc_id")})


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import mixing

    rows = mixing.mix(_documents(spark, sf_dir), budget_share=1.0, repetitions=1.25)
    return rows.select("doc_id", "source", mixing.word_tokens().alias("n_tokens"), "mix_copy", "mix_block", "mix_order")


def _licence_oracle() -> str:
    from transitframe.llm import licences

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    line = licences.COPYRIGHT_LINE

    def lines(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), {quoted(line)}, '', 'g')"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        out = f"' ' || regexp_replace({out}, ' ?\\n ?', E' \\n ', 'g') || ' '"
        for spelling, unified in licences.SPELLINGS:
            if spelling != unified:
                out = f"replace({out}, {quoted(spelling)}, {quoted(unified)})"
        return out

    def whole(text: str) -> str:
        return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licences.KNOWN)
    return f"""
with known as (select min(name) as licence, sha256(t) as digest
               from (select name, {whole(lines('text'))} as t from (values {values}) v(name, text)) where t <> '' group by t),
d as (select doc_id, {lines('text')} as l from documents),
w as (select doc_id, l, sha256({whole('l')}) as text_digest from d),
u as (select distinct doc_id, licence from (select doc_id, sha256(trim(unnest(string_split(l, E'\\n')))) as digest from d) join known using (digest))
select w.doc_id, text_digest, k.licence, coalesce(u2.names, '') as line_licences
from w left join known k on k.digest = w.text_digest
left join (select doc_id, string_agg(licence, ',' order by licence) as names from u group by doc_id) u2 on u2.doc_id = w.doc_id
"""


@query("op10_licences", _licence_oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm import licences

    return licences.scan(_documents(spark, sf_dir), licences.known_licences(spark))


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, with the byte table ``crc_table`` in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_CRC_TABLE = """crc_table as (
    select list(v order by i) as t
    from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))
)"""


def _lower_sql(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_resampling", f"""
with {_CRC_TABLE},
d as (select doc_id, regexp_extract_all({_lower_sql('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
b as (select regexp_extract_all({_lower_sql('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
dw as (select doc_id, w, count(*) as n from (select doc_id, unnest(w) as w from d) group by doc_id, w),
bw as (select w, count(*) as n from (select unnest(w) as w from b) group by w),
vocabulary as (select w, {_crc_sql('w')} % 10000 as bucket from (select distinct w from (select w from dw union all select w from bw)), crc_table),
s as (select bucket, sum(n) as s from dw join vocabulary using (w) group by bucket),
t as (select bucket, sum(n) as t from bw join vocabulary using (w) group by bucket),
gains as (
    select r.bucket, cast(floor(1000.0::double * ln(cast((coalesce(t, 0) + 1) * ((select coalesce(sum(s), 0) from s) + 10000) as double)
                                                    / cast((coalesce(s, 0) + 1) * ((select coalesce(sum(t), 0) from t) + 10000) as double))) as bigint) as gain
    from range(10000) r(bucket) left join s using (bucket) left join t using (bucket)
),
weights as (select doc_id, cast(floor(sum(n * gain) / cast(sum(n) as double)) as bigint) as weight from dw join vocabulary using (w) join gains using (bucket) group by doc_id),
scored as (
    select d.doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + cast(floor(-1000.0::double * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))) as bigint) as score
    from d left join weights using (doc_id)
),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20)
select scored.*, case when rank <= (select count(*) * 10 // 100 from ranked) then rank end as rank from scored left join ranked using (doc_id)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm.resampling import resample

    return resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm.fingerprints import fingerprints

    return fingerprints(_documents(spark, sf_dir))


@query("op13_spelling_variants", f"""
with recursive {_CRC_TABLE},
runs as (
    select doc_id, w, count(*) as n
    from (select doc_id, unnest(regexp_extract_all({_lower_sql('text')}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) as w from documents) group by doc_id, w
),
hashed as (select w, n, {_crc_sql("coalesce(cast(doc_id as varchar), '') || ':' || w")} as h from runs, crc_table),
results as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from results where length(word) >= 6 group by word having sum(n) >= 5),
drops as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
near as (
    select a.word, b.word as other, b.n as other_n from drops a join drops b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select d.word, w.word, w.n from drops d join words w on w.word = d.rest
    union select w.word, d.word, d.n from drops d join words w on w.word = d.rest
),
best as (select word, count(*) as n_near, max(other_n) as top from near group by word),
forms as (
    select word, min(encode(other)) as form, any_value(top) as form_n from near join best using (word) join words using (word)
    where other_n = top and top >= 5 * n group by word
),
chain as (
    select word, word as here, 0 as steps from words
    union all select c.word, decode(f.form), c.steps + 1 from chain c join forms f on f.word = c.here
),
roots as (select word, arg_max(here, steps) as root from chain group by word)
select w.word, decode(f.form) as form, root, n, coalesce(n_near, 0) as n_near, form_n
from words w join roots using (word) left join best using (word) left join forms f using (word)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transitframe.llm.spelling import variants

    return variants(_documents(spark, sf_dir))
