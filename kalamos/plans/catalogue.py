"""Every query of the engine's own operators, by name, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalamos.functions import text as T
from kalamos.operators import batching, history, lexicon, metrics, rows, runs, spans, splits, variants
from kalamos.operators.retrieval import nearest
from kalamos.plans import pipeline
from kalamos.plans import sql_text as S
from kalamos.session import new_folder, spread
from kalamos.sources import readers, sinks

FLAGSHIP = "tfidf_1nn"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CORPUS = "golden_corpus_v2_prefilt"


LONG = (CORPUS, "documents", "sentence_pairs", "independent_test_set_clean")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in LONG else df  # texts are what the expressions cost


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can say it on whole tables."""

    def add(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE[make.__name__] = sql
        return make

    return add


# --- filters and sets --------------------------------------------------------


@query(f"select row_id, oare_id from {CORPUS} c where oare_id is null or not exists (select 1 from new_test_set t where t.oare_id = c.oare_id)")
def holdout_exclusion(spark, folder):
    held = table(spark, folder, "new_test_set").select("oare_id")
    return rows.exclude_documents(table(spark, folder, CORPUS), held).select("row_id", "oare_id")


@query("select distinct id from (select doc_id as id from independent_test_set_clean union all select oare_id from new_test_set) where id is not null and trim(id) <> ''")
def holdout_union(spark, folder):
    return rows.union_ids(table(spark, folder, "independent_test_set_clean").select("doc_id"), table(spark, folder, "new_test_set").select("oare_id"))


@query(f"select distinct oare_id as id from {CORPUS} where oare_id in (select oare_id from new_test_set) and oare_id is not null")
def common_documents(spark, folder):
    ids = lambda t: table(spark, folder, t).select(F.col("oare_id").alias("id")).where("id is not null")
    return rows.common_ids(ids(CORPUS), ids("new_test_set"))


@query(f"select distinct oare_id as id from {CORPUS} where oare_id is not null except select oare_id from new_test_set except select doc_id from independent_test_set_clean")
def remaining_documents(spark, folder):
    ids = lambda t, c="oare_id": table(spark, folder, t).select(F.col(c).alias("id"))
    return rows.remaining_ids(ids(CORPUS).where("id is not null"), ids("new_test_set"), ids("independent_test_set_clean", "doc_id"))


@query(f"select row_id from {CORPUS} where {S.strip('transliteration')} <> '' and {S.strip('translation')} <> ''")
def visible_pairs(spark, folder):
    return rows.visible_pairs(rows.complete_pairs(table(spark, folder, CORPUS))).select("row_id")


@query(
    f"select row_id from {CORPUS} where transliteration is not null and length(translation) >= 10 and greatest(length(transliteration), length(translation)) / greatest(1, least(length(transliteration), length(translation))) <= 10.0"
    f" and not regexp_matches(translation, '{S.METADATA}')"
)
def quality_filter(spark, folder):
    return rows.quality(rows.complete_pairs(table(spark, folder, CORPUS))).select("row_id")


@query(f"select row_id, cast(len({S.words('transliteration')}) as int) as n_words from {CORPUS} where len({S.words('transliteration')}) between 10 and 20")
def word_count_filter(spark, folder):
    return rows.word_range(table(spark, folder, CORPUS), "transliteration", 10, 20).select("row_id", T.word_count(F.col("transliteration")).alias("n_words"))


@query(f"select row_id from {CORPUS} where alignment_method = 'document' and length(transliteration) between 20 and 200 and length(translation) between 15 and 200 and source in ('train', 'published_texts')")
def granularity_and_ranges(spark, folder):
    df = rows.granularity(table(spark, folder, CORPUS), "document", "alignment_method")
    df = rows.between_lengths(df, {"transliteration": (20, 200), "translation": (15, 200)})
    return rows.among(df, "source", ("train", "published_texts")).select("row_id")


@query("select test_id, genre, source, sentence_idx from (select test_id, genre, cast(null as varchar) as source, sentence_idx from independent_test_set_clean union all select test_id, genre, source, null from new_test_set)")
def stacked_tests(spark, folder):
    both = rows.stacked(table(spark, folder, "independent_test_set_clean"), table(spark, folder, "new_test_set"))
    return both.select("test_id", "genre", "source", "sentence_idx")


@query(f"select row_id, 'translate: ' || translation as translation from {CORPUS} where translation is not null")
def source_prefix(spark, folder):
    df = rows.prefixed(table(spark, folder, CORPUS), "translation", "translate: ")
    return rows.without_columns(df, "transliteration", "no_such_column").where("translation is not null").select("row_id", "translation")


# --- normalisation -----------------------------------------------------------


@query(f"select row_id, {S.normalize('transliteration')} as text from {CORPUS}")
def normalize_base(spark, folder):
    return table(spark, folder, CORPUS).select("row_id", T.normalize_transliteration(F.col("transliteration")).alias("text"))


@query(f"select row_id, {S.normalize('transliteration', determinatives=True)} as bare, {S.normalize('transliteration', gaps=True)} as gapless, {S.normalize('transliteration', tags=True)} as tagged from {CORPUS}")
def normalize_ablations(spark, folder):
    x = F.col("transliteration")
    return table(spark, folder, CORPUS).select(
        "row_id",
        T.normalize_transliteration(x, strip_determinatives=True).alias("bare"),
        T.normalize_transliteration(x, remove_gaps=True).alias("gapless"),
        T.normalize_transliteration(x, tag_sumerograms=True).alias("tagged"),
    )


@query(f"select row_id, {S.whitespace(S.minimal('transliteration'))} as source, {S.whitespace('nfc_normalize(translation)')} as target from {CORPUS}")
def normalize_unicode(spark, folder):
    return table(spark, folder, CORPUS).select("row_id", T.normalize_minimal(F.col("transliteration")).alias("source"), T.clean_translation(F.col("translation")).alias("target"))


@query(f"select row_id, count(*) as sumerograms from (select row_id, unnest({S.words('transliteration')}) as w from {CORPUS}) where regexp_matches(w, '^[A-ZÀ-Ž0-9.₀-₉]+$') group by row_id")
def sumerogram_counts(spark, folder):
    df = table(spark, folder, CORPUS).select("row_id", F.size(F.filter(T.words(F.col("transliteration")), T.is_sumerogram)).cast("long").alias("sumerograms"))
    return df.where("sumerograms > 0")


@query(f"select row_id, {S.genre('genre')} as genre_tag, {S.strip('''('genre_' || ''' + S.genre('genre') + ''' || ' source_text ' || ''' + S.normalize('''coalesce(transliteration, 'nan')''') + ')')} as transliteration from {CORPUS}")
def genre_conditioning(spark, folder):
    return variants.genre_conditioned(table(spark, folder, CORPUS)).select("row_id", "genre_tag", "transliteration")


@query(
    rf"""with t as (select distinct unnest({S.words('transliteration')}) as token from {CORPUS}),
    d as (select token, cast(token as decimal(18, 6)) as x from t where regexp_matches(token, '^[0-9]+\.[0-9]+$')),
    c as (select token, x, q, cast(round(x * q) as bigint) as p from d, range(1, 13) r(q)),
    b as (select token, p, q from (select *, row_number() over (partition by token order by abs(cast(x as double) - p::double / q), q) as n from c) where n = 1 and p > 0),
    f as (select token, p // gcd(p, q) as p, q // gcd(p, q) as q from (select token, cast(split_part(token, '/', 1) as bigint) as p, cast(split_part(token, '/', 2) as bigint) as q from t where regexp_matches(token, '^[0-9]{{1,12}}/[0-9]{{1,12}}$')) where p > 0 and q > 0)
    select token, case when p % q = 0 then cast(p // q as varchar) when p < q then p || '_' || q else (p // q) || '_' || (p % q) || '_' || q end as tag from (select token, p, q from b union all select token, p, q from f where q <= 12)"""
)
def numeral_tags(spark, folder):
    tokens = table(spark, folder, CORPUS).select(F.explode(T.words(F.col("transliteration"))).alias("token")).where(r"token rlike '^[0-9]+\\.[0-9]+$' or token rlike '^[0-9]{1,12}/[0-9]{1,12}$'").distinct()
    said = tokens.select("token", T.annotate_numbers(F.col("token")).alias("a"))
    return said.select("token", F.regexp_extract("a", "num_value_(.*)$", 1).alias("tag")).where("tag <> ''")


def _tagged(x: str) -> str:
    """``w`` with each word of a number followed by its tag (``tags`` holds the words that have one)."""
    return f"""t as (select row_id, {S.words(x)} as w from {CORPUS}), e as (select row_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as k from t), j as (select row_id, k, token, tag from e left join tags using (token)),
    said as (select row_id, string_agg(case when tag is null then token else token || ' num_value_' || tag end, ' ' order by k) as transliteration, cast(count(tag) as int) as numeral_annotation_count from j group by row_id)
    select c.row_id, coalesce(said.transliteration, '') as transliteration, coalesce(numeral_annotation_count, 0) as numeral_annotation_count from {CORPUS} c left join said using (row_id)"""


def _tags(x: str) -> str:
    return rf"""t0 as (select distinct unnest({S.words(x)}) as token from {CORPUS}),
    d as (select token, cast(token as decimal(18, 6)) as x from t0 where regexp_matches(token, '^[0-9]+\.[0-9]+$')), c as (select token, x, q, cast(round(x * q) as bigint) as p from d, range(1, 13) r(q)),
    b as (select token, p, q from (select *, row_number() over (partition by token order by abs(cast(x as double) - p::double / q), q) as n from c) where n = 1 and p > 0),
    f as (select token, p // gcd(p, q) as p, q // gcd(p, q) as q from (select token, cast(split_part(token, '/', 1) as bigint) as p, cast(split_part(token, '/', 2) as bigint) as q from t0 where regexp_matches(token, '^[0-9]{{1,12}}/[0-9]{{1,12}}$')) where p > 0 and q > 0),
    tags as (select token, case when p % q = 0 then cast(p // q as varchar) when p < q then p || '_' || q else (p // q) || '_' || (p % q) || '_' || q end as tag from (select token, p, q from b union all select token, p, q from f where q <= 12))"""


_NAN = "coalesce(transliteration, 'nan')"


@query(f"with {_tags(S.normalize(_NAN))}, {_tagged(S.normalize(_NAN))}")
def numeral_annotation(spark, folder):
    return variants.numeral_normalized(table(spark, folder, CORPUS)).select("row_id", "transliteration", "numeral_annotation_count")


@query()
def postprocess_output(spark, folder):
    said = F.concat_ws(" ", "translation", F.substring("translation", 1, 40), F.substring("translation", 1, 40), F.lit(", , end .."))
    return table(spark, folder, CORPUS).where("translation is not null").select("row_id", T.postprocess_translation(said).alias("text"))


def _cut(x: str, n: int) -> str:
    """The longest prefix of whole characters within ``n`` bytes, stripped if it is not everything."""
    return f"case when strlen({x}) <= {n} then {x} else {S.strip(f'left({x}, cast(list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left({x}, k)) <= {n})) as integer))')} end"


@query(f"select row_id, {', '.join(f'{_cut(chr(34) + 'transliteration' + chr(34), n)} as b{n}' for n in (96, 160, 220))} from {CORPUS}")
def utf8_truncation(spark, folder):
    return table(spark, folder, CORPUS).select("row_id", *(T.utf8_truncate(F.col("transliteration"), n).alias(f"b{n}") for n in (96, 160, 220)))


@query(f"select cast(count(*) as bigint) as rows, cast(floor(quantile_cont(strlen(x), 0.95)) as bigint) as p95, cast(max(strlen(x)) as bigint) as most from (select 'genre_' || {S.genre('genre')} || ' source_text ' || {S.normalize('''coalesce(transliteration, 'nan')''')} as y, {S.strip('y')} as x from {CORPUS})")
def variant_manifest(spark, folder):
    return variants.source_bytes(variants.genre_conditioned(table(spark, folder, CORPUS)))


# --- sentences from anchors --------------------------------------------------

_DOCS = """docs as (select doc_id as oare_id, string_agg(transliteration, ' ' order by sentence_idx, pair_id) as transliteration, string_agg(translation, ' ' order by sentence_idx, pair_id) as translation
    from sentence_pairs where doc_id is not null group by doc_id)"""
_ANCHORS = f"""anchors as (select doc_id as text_uuid, word_start + 1 as n, {S.words('transliteration')}[1] as spelling, translation, pair_id as o from sentence_pairs where word_start is not null)"""
_SPANS = f"""spans as (select array_to_string(words[s + 1:e], ' ') as transliteration, {S.strip('translation')} as translation, doc_id, cast(idx as int) as sentence_idx,
      coalesce(a <> '' and b <> '' and (a = b or translate(a, '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x') = translate(b, '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x') or starts_with(a, b) or starts_with(b, a)), false) as anchor_valid, cast(s as int) as word_start, cast(e as int) as word_end
    from (select p.*, d.words, coalesce(nxt, len(d.words)) as e, lower({S.strip('d.words[s + 1]')}) as a, lower({S.strip('p.spelling')}) as b from
      (select text_uuid as doc_id, n - 1 as s, lead(n) over w - 1 as nxt, row_number() over w - 1 as idx, coalesce(spelling, 'nan') as spelling, translation from anchors where text_uuid is not null window w as (partition by text_uuid order by n, o)) p
      join (select oare_id as doc_id, {S.words('transliteration')} as words from docs where transliteration is not null) d using (doc_id))
    where s >= 0 and s < len(words) and e > s and {S.strip('translation')} <> '')"""


def _documents(spark, folder):
    """Whole documents and anchors, told from the sentences of the SentencePair table."""
    p = table(spark, folder, "sentence_pairs")
    line = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("sentence_idx", "pair_id", c)))), lambda x: x[c]), " ")
    docs = p.where("doc_id is not null").groupBy(F.col("doc_id").alias("oare_id")).agg(line("transliteration").alias("transliteration"), line("translation").alias("translation"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    docs = docs.select("oare_id", some("transliteration").alias("transliteration"), some("translation").alias("translation"), F.lit(0).alias("ordinal"))
    anchors = p.where("word_start is not null").select(
        F.col("doc_id").alias("text_uuid"), (F.col("word_start") + 1).alias("first_word_number"), F.get(T.words(F.col("transliteration")), F.lit(0)).alias("first_word_spelling"), "translation", F.col("pair_id").alias("ordinal")
    )
    return docs, anchors


@query(f"with {_DOCS}, {_ANCHORS}, {_SPANS} select * from spans")
def sentence_spans(spark, folder):
    return spans.sentence_spans(*_documents(spark, folder))


@query(
    f"""with {_DOCS}, {_ANCHORS}, {_SPANS}
    select transliteration, translation, doc_id, sentence_idx, anchor_valid, word_start, word_end, 'sentence' as data_type from spans where anchor_valid union all
    select transliteration, translation, oare_id, null, null, null, null, 'document' from docs where oare_id not in (select text_uuid from anchors where text_uuid is not null) and {S.strip('transliteration')} <> '' and {S.strip('translation')} <> ''"""
)
def mixed_rows(spark, folder):
    return spans.mixed_rows(*_documents(spark, folder))


_KNOWN = f"(select oare_id from {CORPUS} where oare_id is not null)"


@query(
    f"""with all_{_DOCS}, {_ANCHORS}, docs as (select * from all_docs where oare_id in {_KNOWN} or oare_id not in (select doc_id from independent_test_set_clean where doc_id is not null)), {_SPANS}
    select *, case when doc_id in {_KNOWN} then 'train' else 'published' end as source from spans"""
)
def extended_rows(spark, folder):
    """Documents that the corpus knows are the training ones, the others the published ones."""
    docs, anchors = _documents(spark, folder)
    known = table(spark, folder, CORPUS).select("oare_id").where("oare_id is not null").distinct()
    held = table(spark, folder, "independent_test_set_clean").select("doc_id").where("doc_id is not null")
    return spans.extended_rows(docs.join(known, "oare_id", "left_semi"), anchors, docs.join(known, "oare_id", "left_anti").drop("translation"), held)


@query(
    f"""with {_DOCS}, {_ANCHORS}, {_SPANS}, w as (select anchor_valid, len({S.words('transliteration')}) as n from spans)
    select (select count(distinct oare_id) from docs) as train_docs, (select count(distinct text_uuid) from anchors) as anchor_docs, (select count(distinct oare_id) from docs where oare_id in (select text_uuid from anchors)) as docs_with_anchors,
    count(*) as pairs, count_if(anchor_valid) as valid, count_if(not anchor_valid) as invalid, round(avg(anchor_valid::int), 6) as match_rate, round(avg(n), 6) as avg_words, cast(min(n) as bigint) as min_words, cast(max(n) as bigint) as max_words from w"""
)
def extraction_statistics(spark, folder):
    return spans.extraction_statistics(*_documents(spark, folder))


# --- splits ------------------------------------------------------------------


@query(
    f"""with r as (select oare_id, row_number() over (order by md5('42:' || oare_id), oare_id) as k, count(*) over () as n from (select distinct oare_id from {CORPUS} where oare_id is not null))
    select row_id, case when k <= ceil(n * 0.1) then 'validation' else 'train' end as split from {CORPUS} join r using (oare_id)"""
)
def doc_group_split(spark, folder):
    train, held = splits.split_documents(table(spark, folder, CORPUS), 0.1)
    return train.select("row_id", F.lit("train").alias("split")).unionAll(held.select("row_id", F.lit("validation").alias("split")))


@query(f"select row_id, case when k <= ceil(n * 0.1) then 'validation' else 'train' end as split from (select row_id, row_number() over (order by md5('42:' || row_id), row_id) as k, count(*) over () as n from {CORPUS})")
def row_split(spark, folder):
    train, held = splits.split_rows(table(spark, folder, CORPUS), 0.1, "row_id")
    return train.select("row_id", F.lit("train").alias("split")).unionAll(held.select("row_id", F.lit("validation").alias("split")))


@query(
    f"""with d as (select row_id, coalesce(oare_id, 'nan') as doc from {CORPUS}), r as (select doc, row_number() over (order by md5('42:' || doc), doc) as k, count(*) over () as n from (select distinct doc from d))
    select s.share, count(distinct doc) as docs, count(*) as rows from d join r using (doc) join (values (0.25), (0.5), (0.75)) s(share) on k <= greatest(1, floor(n * s.share::double)) group by s.share"""
)
def nested_subsets(spark, folder):
    parts = splits.nested_subsets(table(spark, folder, CORPUS), [0.25, 0.5, 0.75])
    out = None
    for share, df in parts.items():
        one = df.agg(F.lit(share).cast("decimal(3,2)").alias("share"), F.count_distinct(F.coalesce("oare_id", F.lit("nan"))).alias("docs"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionAll(one)
    return out


# --- glosses -----------------------------------------------------------------

_FORM = lambda x: f"replace(translate(lower({S.strip(x)}), '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x'), 'ḫ', 'h')"
_ROMAN = rf"{S.WS}+[IVX]+$"
_QUOTED = """regexp_extract(definition, '"([^"]+)"', 1)"""
_LOOKUP = f"""d as (select {S.strip("coalesce(word, 'nan')")} as word, {S.strip(f"split_part(split_part({_QUOTED}, ';', 1), ',', 1)")} as gloss, row_number() over (order by word nulls first, definition nulls first, derived_from nulls first) as o from ebl_dictionary),
    e as (select *, {S.strip(S.sub('word', _ROMAN, ''))} as base from d where gloss <> ''),
    k as (select lower(word) as key, gloss, o, 1 as own from e union all select {_FORM('word')}, gloss, o, 1 from e union all select lower(base), gloss, o, 0 from e where base <> word union all select {_FORM('base')}, gloss, o, 0 from e where base <> word),
    keys as (select key, gloss from (select *, row_number() over (partition by key order by own desc, case when own = 1 then -o else o end) as n from k) where n = 1),
    f as (select {S.strip("coalesce(form, 'nan')")} as form, {S.strip("coalesce(lexeme, 'nan')")} as lexeme, row_number() over (order by entry_type nulls first, form nulls first, norm nulls first, lexeme nulls first, ebl nulls first) as o from oa_lexicon_ebl where entry_type = 'word'),
    lookup as (select form, gloss from (select form, gloss, row_number() over (partition by form order by o) as n from (select {_FORM('f.form')} as form, coalesce(a.gloss, b.gloss) as gloss, o
      from f left join keys a on a.key = lower(f.lexeme) left join keys b on b.key = {_FORM('f.lexeme')} where f.form not in ('', 'nan') and f.lexeme not in ('', 'nan')) where gloss is not null) where n = 1)"""


def _gloss_tables(spark, folder):
    words, forms = table(spark, folder, "ebl_dictionary"), table(spark, folder, "oa_lexicon_ebl").where("entry_type = 'word'")
    # fixed lexical tables without a key: their order is their content
    place = lambda df: df.withColumn("ordinal", F.row_number().over(Window.orderBy(*(F.asc_nulls_first(c) for c in df.columns))))
    return lexicon.gloss_lookup(place(words.select("word", "definition", "derived_from")), place(forms.select("entry_type", "form", "norm", "lexeme", "ebl")))


@query(f"with {_LOOKUP} select form, gloss from lookup")
def gloss_lookup(spark, folder):
    return _gloss_tables(spark, folder)


@query(
    f"""with {_LOOKUP}, t as (select row_id, list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: x[1] not in ('<gap>', '<big_gap>') and not regexp_matches(x[1], '^[A-ZÀ-Ž0-9.]+$')) as toks from (select row_id, {S.words('transliteration')} as w from {CORPUS})),
    h as (select row_id, x[1] as token, x[2] as pos from (select row_id, unnest(toks) as x from t)),
    g as (select row_id, pos, token || ': ' || gloss as g, row_number() over (partition by row_id order by pos) as n from h join lookup on lookup.form = {_FORM('token')}),
    s as (select row_id, string_agg(g, '; ' order by pos) as said from g where n <= 8 group by row_id)
    select c.row_id, case when said is null then transliteration else transliteration || ' || ' || said end as transliteration from {CORPUS} c left join s using (row_id)"""
)
def gloss_augment(spark, folder):
    return lexicon.augment_with_glosses(table(spark, folder, CORPUS).select("row_id", "transliteration"), _gloss_tables(spark, folder), "row_id")


# --- retrieval ---------------------------------------------------------------


def _tfidf(bank: str, asked: str, same: bool, by_word: bool = False) -> str:
    text = lambda x: S.sub(x, f"{S.WS}{{2,}}", " ")
    of = lambda t: f"(select id, ' ' || unnest({S.words('t')}) || ' ' as t from {t})" if by_word else t
    grams = lambda t: " union all ".join(f"select id, unnest({S.char_grams('t', k)}) as g from {of(t)}" for k in (3, 4, 5))
    return f"""with bank as ({bank.format(text=text)}), asked as ({asked.format(text=text)}),
    btf as (select id, g, count(*) as tf from ({grams('bank')}) group by id, g), qtf as (select id, g, count(*) as tf from ({grams('asked')}) group by id, g),
    n as (select count(*) as n, min(id) as one from bank), idf as (select g, ln((1 + n) / (1.0 + count(*))) + 1 as idf from btf, n group by g, n),
    bw as (select id, g, tf * idf as w from btf join idf using (g)), qw as (select id, g, tf * idf as w from qtf join idf using (g)),
    bn as (select id, sqrt(sum(w * w)) as norm from bw group by id), qn as (select id, sqrt(sum(w * w)) as norm from qw group by id),
    dots as (select q.id as q, b.id as b, sum(q.w * b.w) as dot from qw q join bw b using (g) where {'q.id <> b.id' if same else 'true'} group by 1, 2),
    best as (select q, b, s from (select q, b, dot / qn.norm / bn.norm as s, row_number() over (partition by q order by round(dot / qn.norm / bn.norm, 12) desc, b) as k from dots join qn on qn.id = q join bn on bn.id = b) where k = 1)
    select a.id as query_id, coalesce(best.b, {"case when a.id = n.one then (select min(id) from bank where id <> n.one) else n.one end" if same else "n.one"}) as bank_id, round(coalesce(best.s, 0), 6) as score from asked a cross join n left join best on best.q = a.id"""


_ASKED = "select test_id as id, {text} as t from independent_test_set_clean union all select test_id, {text} from new_test_set".replace("{text}", S.sub("coalesce(transliteration, '')", f"{S.WS}{{2,}}", " ").replace("{", "{{").replace("}", "}}"))
_BANK = f"select row_id as id, {S.sub('''coalesce(transliteration, '')''', f'{S.WS}{{2,}}', ' ')} as t from {CORPUS} where transliteration is not null and translation is not null".replace("{", "{{").replace("}", "}}")
_SELF = "select test_id as id, {text} as t from new_test_set".replace("{text}", S.sub("coalesce(transliteration, '')", f"{S.WS}{{2,}}", " ").replace("{", "{{").replace("}", "}}"))


def _all_tests(spark, folder):
    tests = [table(spark, folder, t).select("test_id", "transliteration", "translation") for t in ("independent_test_set_clean", "new_test_set")]
    return tests[0].unionAll(tests[1])


@query(_tfidf(_BANK, _ASKED, False))
def tfidf_1nn(spark, folder):
    bank = rows.complete_pairs(table(spark, folder, CORPUS))
    found = nearest(_all_tests(spark, folder), bank, "test_id", "transliteration", "row_id", "transliteration")
    return found.withColumn("score", F.round("score", 6))


@query(_tfidf(_BANK, _SELF, False, True))
def tfidf_within_words(spark, folder):
    bank = rows.complete_pairs(table(spark, folder, CORPUS))
    found = nearest(table(spark, folder, "new_test_set"), bank, "test_id", "transliteration", "row_id", "transliteration", analyzer="char_wb")
    return found.withColumn("score", F.round("score", 6))


@query(_tfidf(_SELF, _SELF, True))
def tfidf_self_nn(spark, folder):
    t = table(spark, folder, "new_test_set")
    return nearest(t, t, "test_id", "transliteration", "test_id", "transliteration", exclude_self=True).withColumn("score", F.round("score", 6))


@query()
def retrieval_variants(spark, folder):
    evals = {name: table(spark, folder, t).withColumnRenamed("test_id", "row_id") for name, t in (("independent", "independent_test_set_clean"), ("new_test", "new_test_set"))}
    out = None
    for name, parts in variants.retrieval_augmented(table(spark, folder, CORPUS), evals, holdout_union(spark, folder), "row_id").items():
        for split, df in parts.items():
            one = df.select("row_id", F.lit(name).alias("format"), F.lit(split).alias("split"), "retrieved_doc_id", F.round("retrieved_score", 6).alias("retrieved_score"), "transliteration")
            out = one if out is None else out.unionAll(one)
    return out


@query()
def retrieval_baseline_scores(spark, folder):
    """The whole load pipeline of training rows (hold-outs, complete pairs, quality, normalisation, visible pairs), its
    rows as the bank, and both test sets."""
    data = pipeline_defaults(filter_quality=True)
    train = pipeline.prepare(table(spark, folder, CORPUS), spark, data, holdout_union(spark, folder))
    both = None
    for name in ("independent_test_set_clean", "new_test_set"):
        test = table(spark, folder, name).select("test_id", "transliteration", "translation", F.lit(name).alias("test_set"))
        both = test if both is None else both.unionAll(test)
    said = pipeline.predict_nearest(train, pipeline.normalised(both, data), "row_id", "test_id")
    return pipeline.evaluate(said, "translation", "test_set")


def pipeline_defaults(**given):
    from kalamos.sources.config import DataConfig

    return DataConfig(**given)


# --- metrics -----------------------------------------------------------------

_PAIRS = "select test_id as id, coalesce(translation, '') as r, coalesce(lead(translation) over (order by test_id), '') as h from independent_test_set_clean"


def _predictions(spark, folder):
    """Each test row with the next row's translation as its prediction, next within the ids' own order."""
    t = table(spark, folder, "independent_test_set_clean").select(F.col("test_id").alias("id"), "translation")
    nxt = t.select((F.col("id") - 1).alias("id"), F.col("translation").alias("prediction"))
    return t.join(nxt, "id", "left").select("id", F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce("prediction", F.lit("")).alias("prediction"))


def _stat_sql(pairs: str = _PAIRS) -> str:
    """Tables ``s`` (per pair and kind of n-gram: counts of both sides and common ones) and ``l`` (token counts)."""
    parts = []
    for fam, orders, unit in (("b", range(1, 5), "tok"), ("c", range(1, 7), "chr"), ("w", range(1, 3), "wrd")):
        for n in orders:
            grams = (lambda x, n=n, unit=unit: S.char_grams(f"{x}_{unit}", n) if unit == "chr" else S.list_grams(f"{x}_{unit}", n))
            for x in ("h", "r"):
                parts.append(f"select id, '{fam}{n}' as k, '{x}' as side, unnest({grams(x)}) as g from u")
    return f"""p as ({pairs}), u as (select id, {S.tokens_13a('h')} as h_tok, {S.tokens_13a('r')} as r_tok, {S.sub('h', S.WS + '+', '')} as h_chr, {S.sub('r', S.WS + '+', '')} as r_chr, {S.word_units('h')} as h_wrd, {S.word_units('r')} as r_wrd from p),
    g as (select id, k, g, count_if(side = 'h') as nh, count_if(side = 'r') as nr from ({' union all '.join(parts)}) group by id, k, g),
    s as (select id, k, sum(nh) as nh, sum(nr) as nr, sum(least(nh, nr)) as m from g group by id, k),
    l as (select id, len(h_tok) as hl, len(r_tok) as rl from u),
    totals as (select k, sum(case when nr > 0 or k like 'b%' then nh else 0 end) as nh, sum(nr) as nr, sum(m) as m from s group by k),
    lens as (select sum(hl) as hl, sum(rl) as rl from l)"""


_SENTENCE = """q as (select id, case when m > 0 then 100.0 * m / nh else 100.0 / (pow(2, sum(case when m = 0 then 1 else 0 end) over (partition by id order by k)) * nh) end as p, m from s where k like 'b%' and nh > 0),
    sb as (select id, case when sum(m) = 0 then 0 else exp(avg(ln(p))) end as raw from q group by id),
    sc as (select id, avg(m / nh) as p, avg(m / nr) as r from s where k not like 'b%' and nh > 0 and nr > 0 group by id),
    sentence as (select l.id, coalesce(raw, 0) * case when hl >= rl then 1.0 when hl = 0 then 0.0 else exp(1 - rl / hl) end as bleu, case when 4 * sc.p + sc.r > 0 then 100 * 5 * sc.p * sc.r / (4 * sc.p + sc.r) else 0 end as chrf from l left join sb using (id) left join sc using (id))"""

_BLEU_SQL = """bleu as (select case when count(*) < 4 or sum(m) = 0 then 0 else exp(avg(ln(p))) * any_value(case when hl >= rl then 1.0 else exp(1 - rl / hl) end) end as bleu from
      (select *, case when m > 0 then 100.0 * m / nh else 100.0 / (pow(2, sum(case when m = 0 then 1 else 0 end) over (order by k)) * nh) end as p from totals where k like 'b%' and nh > 0), lens),
    chrf as (select avg(m / nh) as p, avg(m / nr) as r from totals where k not like 'b%' and nh > 0 and nr > 0), f as (select 100 * 5 * p * r / (4 * p + r) as chrf from chrf)"""


@query(f"with {_stat_sql()}, {_BLEU_SQL} select round(bleu, 6) as bleu, round(chrf, 6) as chrf, round(sqrt(bleu * chrf), 6) as combined from bleu, f")
def corpus_scores(spark, folder):
    out = metrics.corpus_scores(metrics.statistics(_predictions(spark, folder), "prediction", "translation"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"with {_stat_sql()} select k, cast(nh as bigint) as hyp, cast(nr as bigint) as ref, cast(m as bigint) as matched from totals where k not like 'b%'")
def chrf_stats(spark, folder):
    s = metrics.statistics(_predictions(spark, folder), "prediction", "translation")
    names = [f"c{n}" for n in range(1, 7)] + ["w1", "w2"]
    sums = s.agg(*(F.sum(c).alias(c) for c in metrics.CHRF))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"chrf_hyp_{i}").alias("hyp"), F.col(f"chrf_ref_{i}").alias("ref"), F.col(f"chrf_match_{i}").alias("matched")) for i, k in enumerate(names, 1)))))


@query(f"with {_stat_sql()} select k, cast(nh as bigint) as total, cast(m as bigint) as matched from totals where k like 'b%'")
def bleu_stats(spark, folder):
    sums = metrics.statistics(_predictions(spark, folder), "prediction", "translation").agg(*(F.sum(c).alias(c) for c in metrics.BLEU))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(f"b{n}").alias("k"), F.col(f"total_{n}").alias("total"), F.col(f"match_{n}").alias("matched")) for n in range(1, 5)))))


@query(f"with {_stat_sql()}, {_SENTENCE} select id, round(bleu, 6) as bleu, round(chrf, 6) as chrf, round(sqrt(bleu * chrf), 6) as combined from sentence")
def sentence_scores(spark, folder):
    out = metrics.sentence_scores(metrics.statistics(_predictions(spark, folder), "prediction", "translation", "id"))
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("bleu", "chrf", "combined")))


_CANDIDATES = f"""t as (select doc_id, {S.strip('translation')} as c, sentence_idx, pair_id from sentence_pairs where doc_id is not null and translation is not null),
    d as (select doc_id, c, i from (select doc_id, c, row_number() over (partition by doc_id order by o) - 1 as i from (select doc_id, c, min((sentence_idx, pair_id)) as o from t where c <> '' group by doc_id, c)) where i < 32),
    e as (select a.doc_id || ':' || a.i || ':' || b.i as id, a.doc_id, a.i, a.c as h, b.c as r from d a join d b on a.doc_id = b.doc_id and a.i <> b.i)"""


@query(
    f"""with {_CANDIDATES}, {_stat_sql('select id, h, r from e')}, {_SENTENCE},
    mean as (select doc_id, i, h, round(avg(chrf), 10) as m from e join sentence using (id) group by doc_id, i, h), best as (select doc_id, h from (select doc_id, h, row_number() over (partition by doc_id order by m desc, i) as n from mean) where n = 1)
    select doc_id, coalesce(best.h, (select c from d where d.doc_id = k.doc_id and i = 0), '') as picked from (select distinct doc_id from t) k left join best using (doc_id)"""
)
def mbr_pick(spark, folder):
    said = table(spark, folder, "sentence_pairs").where("doc_id is not null and translation is not null").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence_idx", "pair_id", "translation"))), lambda x: x["translation"]).alias("candidates"))
    return metrics.pick_candidates(said, "doc_id", "candidates")


_ROUNDS = 2000
_TWO = """select 'one:' || i as id, h, r from x union all select 'two:' || i, r || ' ' || h, r from x"""
_CORPUS = """bb as (select resample, sys, k, m, case when m > 0 then 100.0 * m / nh else 100.0 / (pow(2, sum(case when m = 0 then 1 else 0 end) over (partition by resample, sys order by k)) * nh) end as p from sums where k like 'b%' and nh > 0),
    bleu as (select resample, sys, case when count(*) < 4 or sum(m) = 0 then 0 else exp(avg(ln(p))) end as raw from bb group by resample, sys),
    chrf as (select resample, sys, avg(m / nh) as p, avg(m / nr) as r from sums where k not like 'b%' and nh > 0 and nr > 0 group by resample, sys),
    scores as (select resample, sys, sqrt(coalesce(raw, 0) * case when hl >= rl then 1.0 when hl = 0 then 0.0 else exp(1 - rl / hl) end * case when 4 * p + r > 0 then 500 * p * r / (4 * p + r) else 0 end) as v
      from lsums left join bleu using (resample, sys) left join chrf using (resample, sys))"""


@query(
    f"""with p0 as ({_PAIRS}), x as (select id - (select min(id) from p0) as i, r, h from p0), {_stat_sql(_TWO)},
    n as (select count(*) as n from x), draws as (select resample, cast(('0x' || substring(md5('12345:' || resample || ':' || i), 1, 12))::bigint % n as bigint) as i from x, n, range(0, {_ROUNDS}) t(resample)),
    weight as (select resample, i, count(*) as w from draws group by resample, i union all select -1, i, 1 from x),
    ss as (select split_part(id, ':', 1) as sys, cast(split_part(id, ':', 2) as bigint) as i, k, case when nr > 0 or k like 'b%' then nh else 0 end as nh, nr, m from s),
    ll as (select split_part(id, ':', 1) as sys, cast(split_part(id, ':', 2) as bigint) as i, hl, rl from l),
    sums as (select resample, sys, k, sum(w * nh) as nh, sum(w * nr) as nr, sum(w * m) as m from ss join weight using (i) group by resample, sys, k), lsums as (select resample, sys, sum(w * hl) as hl, sum(w * rl) as rl from ll join weight using (i) group by resample, sys),
    {_CORPUS}, delta as (select a.resample, a.v as one, b.v as two, a.v - b.v as d from scores a join scores b using (resample) where a.sys = 'two' and b.sys = 'one')
    select round(o.one, 6) as score_one, round(o.two, 6) as score_two, round(o.d, 6) as delta, (select round(quantile_cont(d, 0.025), 6) from delta where resample >= 0) as ci_low, (select round(quantile_cont(d, 0.975), 6) from delta where resample >= 0) as ci_high,
    (select round(avg(case when o.d > 0 then (d <= 0)::int else (d >= 0)::int end), 6) from delta where resample >= 0) as p, (select count(*) from delta where resample >= 0) as resamples from delta o where o.resample = -1"""
)
def paired_bootstrap(spark, folder):
    p = _predictions(spark, folder)
    ordered = p.withColumn("idx", F.col("id") - F.lit(p.agg(F.min("id")).first()[0]))
    other = ordered.withColumn("prediction", F.concat_ws(" ", F.col("translation"), F.col("prediction")))
    stats = metrics.statistics(ordered.withColumn("system", F.lit("one")), "prediction", "translation", "idx", "system").unionAll(metrics.statistics(other.withColumn("system", F.lit("two")), "prediction", "translation", "idx", "system"))
    draws = metrics.hashed_draws(ordered, "idx", _ROUNDS, 12345, ordered.count())
    out = metrics.paired_bootstrap(stats, draws, "idx", "system", "two", "one")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


# Made systems: parts of the reference, and the next row's text.
_SYSTEMS = {"full": (3, 4), "part": (1, 4), "small": (1, 2), "small_changed": (2, 3), "full_changed": (1, 2)}
_SAID = " union all ".join([f"select '{n}:' || id as id, left(r, cast(length(r) * {a} // {b} as integer)) as h, r from x" for n, (a, b) in _SYSTEMS.items()] + ["select 'other:' || id, h, r from x"])
_WIDE = ", ".join(f"max(case when split_part(sentence.id, ':', 1) = '{n}' then round(chrf, 6) end) as {n}" for n in (*_SYSTEMS, "other"))
_ORDERS = {
    "system_gap": ('"full" > 40', 'round("full" - other, 6) desc'), "change_by_size": ('small_changed - small > 5 and full_changed - "full" < -5', 'round(small_changed - small - (full_changed - "full"), 6) desc'),
    "formulaic_success": ("genre in ('debt-note', 'memo')", '"full" desc'), "letter_failure": ("""genre = 'letter' and "full" > 15 and "full" < 40""", '"full"'), "more_data": ('"full" > 50', 'round("full" - part, 6) desc'),
}


@query(
    f"""with x as ({_PAIRS}), {_stat_sql(_SAID)}, {_SENTENCE}, w as (select cast(split_part(sentence.id, ':', 2) as bigint) as test_id, {_WIDE.replace('as full,', 'as "full",')} from sentence group by 1),
    m as (select w.*, genre from w join independent_test_set_clean t using (test_id) where length(transliteration) between 20 and 200 and length(translation) between 15 and 200)
    {' union all '.join(f"(select '{n}' as category, test_id from m where {where} order by {order}, test_id limit 8)" for n, (where, order) in _ORDERS.items())}"""
)
def qualitative_examples(spark, folder):
    p = _predictions(spark, folder)
    said = {n: F.expr(f"left(translation, cast(length(translation) * {a} div {b} as int))") for n, (a, b) in _SYSTEMS.items()} | {"other": F.col("prediction")}
    stacked = p.select("id", "translation", F.explode(F.array(*(F.struct(F.lit(n).alias("system"), c.alias("said")) for n, c in said.items()))).alias("s")).select("id", "translation", "s.*")
    scores = metrics.sentence_scores(metrics.statistics(stacked, "said", "translation", "id", "system"))
    wide = scores.groupBy(F.col("id").alias("test_id")).agg(*(F.max(F.when(F.col("system") == n, F.round("chrf", 6))).alias(n) for n in said))
    texts = rows.between_lengths(table(spark, folder, "independent_test_set_clean"), runs.READABLE).select("test_id", "genre")
    return runs.example_table(wide.join(texts, "test_id"), runs.contrasts("test_id", "genre", "full", "other", "part", "small", "small_changed", "full_changed")).select("category", "test_id")


@query(f"""with a as (select row_id, {S.strip("lower(coalesce(genre, ''))")} as g, length(transliteration) as n from {CORPUS})
    select g, cast(n // 50 as bigint) as size, count(n) as runs, round(avg(n), 6) as mean, round(coalesce(stddev_samp(n), 0), 6) as sd, min(n) as least, max(n) as most from a group by 1, 2""")
def seed_curves(spark, folder):
    df = table(spark, folder, CORPUS).select(T.strip(F.lower(F.coalesce("genre", F.lit("")))).alias("g"), F.length("transliteration").alias("n")).withColumn("size", F.floor(F.col("n") / 50))
    out = runs.seed_curves(df, "n", "size", "g")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


# --- runs and histories ------------------------------------------------------

_RUNS = "runs as (select event_type as condition, cast(user_id % 3 as bigint) as seed, case when user_id % 2 = 0 then 'small' else 'base' end as size, avg(value) as score from events group by 1, 2, 3)"


def _runs(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 3).alias("seed"), F.when(F.col("user_id") % 2 == 0, "small").otherwise("base").alias("size")).agg(F.avg("value").alias("score"))


@query(f"with {_RUNS} select condition, size, count(score) as runs, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as sd from runs group by condition, size")
def seed_statistics(spark, folder):
    out = runs.seed_statistics(_runs(spark, folder), "score", "condition", "size")
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


_BASELINE = "(select min(event_type) from events)"


@query(
    f"""with {_RUNS}, d as (select r.condition, r.size, r.seed, r.score - b.score as delta from runs r join runs b on b.size = r.size and b.seed = r.seed and b.condition = {_BASELINE} where r.condition <> {_BASELINE}),
    i as (select condition, avg(delta) filter (size = 'small') as small, avg(delta) filter (size = 'base') as large from d group by condition)
    select condition, round(small, 6) as small, round(large, 6) as large, round(small - large, 6) as interaction from i"""
)
def interaction_check(spark, folder):
    r = _runs(spark, folder)
    first = r.agg(F.min("condition")).first()[0]
    out = runs.interactions(runs.paired_deltas(r, "condition", first, "score", "size", "seed"), "condition", "size", "small", "base")
    return out.select("condition", *(F.round(c, 6).alias(c) for c in ("small", "large", "interaction")))


@query(
    f"""with {_RUNS}, d as (select r.score - b.score as delta from runs r join runs b on b.size = r.size and b.seed = r.seed and b.condition = {_BASELINE} where r.condition <> {_BASELINE})
    select count_if(delta > 0) as positive, count_if(delta < 0) as negative, count(delta) as n, round(min(abs(delta)), 6) as least_abs, round(avg(abs(delta)), 6) as mean_abs, round(pow(0.5, count(delta)), 9) as unanimous_p from d"""
)
def sign_summary(spark, folder):
    r = _runs(spark, folder)
    first = r.agg(F.min("condition")).first()[0]
    out = runs.sign_summary(runs.paired_deltas(r, "condition", first, "score", "size", "seed"), "delta")
    return out.withColumns({"least_abs": F.round("least_abs", 6), "mean_abs": F.round("mean_abs", 6), "unanimous_p": F.round("unanimous_p", 9)})


@query(
    """with e as (select *, row_number() over (partition by user_id, event_id % 2 order by event_id desc) as k from events), one as (select * from e where k = 1 and event_id % 2 = 0), two as (select * from e where k = 1 and event_id % 2 = 1)
    select user_id as run_id, event_type as status, event_id as seed from two union all select user_id, event_type, event_id from one where user_id not in (select user_id from two)"""
)
def run_registry_upsert(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seed"))
    last = lambda odd: metrics.best_rows(e.where(F.col("seed") % 2 == odd), "run_id", [F.desc("seed")])
    return runs.upsert_runs(last(0), last(1), columns=("run_id", "status", "seed"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000 order by o_totalprice desc, o_orderkey limit 8")
def qualitative_topk(spark, folder):
    df = table(spark, folder, "orders")
    return runs.top_rows(df, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("select a.test_id, a.translation as pred_one, b.genre as pred_two, c.transliteration as pred_three from new_test_set a join new_test_set b using (test_id) join new_test_set c using (test_id)")
def aligned_predictions(spark, folder):
    t = table(spark, folder, "new_test_set")
    frames = {n: t.select("test_id", F.col(c).alias("prediction")) for n, c in (("one", "translation"), ("two", "genre"), ("three", "transliteration"))}
    return runs.aligned_predictions(frames, ["test_id"])


_SERIES = "series as (select user_id as run_id, cast(event_id % 50 as int) as step, max_by(value, event_id) as value from events where event_type = (select min(event_type) from events) and value is not null group by 1, 2)"


def _history(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 50).cast("int").alias("step"), F.col("event_type").alias("metric"), "value", F.col("event_id").alias("ordinal"))


@query(f"with {_SERIES} select run_id, step, value, round(avg(value) over (partition by run_id order by step rows between 4 preceding and current row), 6) as smoothed from series")
def loss_curve(spark, folder):
    h = _history(spark, folder)
    name = h.agg(F.min("metric")).first()[0]
    return history.smoothed(history.loss_series(h, name, "ordinal", "run_id"), 5, "run_id").withColumn("smoothed", F.round("smoothed", 6))


@query(
    f"""with {_SERIES} select u.run_id, case when not exists (select 1 from events e where e.user_id = u.run_id) then 'missing_history' when s.num_points is null then 'missing_train_loss' else 'ok' end as status, coalesce(s.num_points, 0) as num_points, s.final_step, s.final_loss
    from (select unnest(range(0, 400)) as run_id) u left join (select run_id, count(*) as num_points, max(step) as final_step, max_by(value, step) as final_loss from series group by run_id) s using (run_id)"""
)
def loss_status(spark, folder):
    h = _history(spark, folder)
    name = h.agg(F.min("metric")).first()[0]
    series = history.loss_series(h, name, "ordinal", "run_id")
    # the SQL's fixed list and, whatever its length, every run of the data
    manifest = spark.range(400).select(F.col("id").alias("run_id")).unionAll(h.select(F.col("run_id").cast("long")).where("run_id is not null")).distinct()
    return history.loss_status(manifest, history.series_summary(series, "run_id"), h)


@query(
    """with a as (select user_id, event_id, value, max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as best_before from events),
    b as (select *, best_before is null or value > best_before as improved, row_number() over (partition by user_id order by event_id) as n from a),
    c as (select *, n - max(case when improved then n end) over (partition by user_id order by event_id) as since from b), d as (select *, sum(case when since >= 5 then 1 else 0 end) over (partition by user_id order by event_id) as hits from c)
    select user_id, event_id, value, best_before, improved, since, since >= 5 and hits = 1 as stops, hits = 0 or (since >= 5 and hits = 1) as running from d"""
)
def early_stopping(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", "value")
    return history.early_stopping(e, "value", ["event_id"], 5, "user_id")


@query(
    """select cast(floor((event_id - 1) / 100) as bigint) as "window", count(*) as batches, sum(user_id) as examples, sum(length(event_type)) as tokens, round(sum(value), 4) as wait_s, round(sum(value * 2), 4) as compute_s,
    round(sum(user_id) / greatest(sum(value) + sum(value * 2), 1e-9), 6) as examples_per_sec, round(sum(length(event_type)) / greatest(sum(value) + sum(value * 2), 1e-9), 6) as tokens_per_sec, round(sum(value) / greatest(sum(value) + sum(value * 2), 1e-9), 6) as wait_share from events group by 1"""
)
def perf_windows(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", F.length("event_type").cast("long").alias("tokens"), "value", (F.col("value") * 2).alias("twice"))
    out = history.throughput(e, history.every(F.col("event_id"), 100), "user_id", "tokens", "value", "twice")
    return out.withColumns({c: F.round(c, n) for c, n in (("wait_s", 4), ("compute_s", 4), ("examples_per_sec", 6), ("tokens_per_sec", 6), ("wait_share", 6))})


@query("select user_id, round(coalesce(sum(value), 0) / greatest(count(value), 1), 6) as mean_loss from events group by user_id")
def epoch_means(spark, folder):
    return history.epoch_means(table(spark, folder, "events"), "user_id", "value").withColumn("mean_loss", F.round("mean_loss", 6))


# --- batches -----------------------------------------------------------------


@query(
    """with r as (select doc_id, coalesce(n_chars, 0) as n_chars, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as r, count(*) over () as total from documents),
    m as (select *, r // 400 as mega_batch from r), p as (select *, mega_batch * 400 + row_number() over (partition by mega_batch order by n_chars desc, md5('42:' || doc_id), doc_id) - 1 as position from m)
    select doc_id, n_chars, total, mega_batch, position, position // 8 as batch from p where total < 8 or position // 8 < total // 8"""
)
def sortish_batches(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return batching.drop_last(batching.sortish(d, "doc_id", "n_chars", 8, 50), 8)


@query(
    """with r as (select event_id, row_number() over (partition by user_id order by event_id) - 1 as p, count(*) over (partition by user_id) as n, user_id from events)
    select event_id, cast(p // 4 as bigint) as optimizer_step, cast(case when n % 4 > 0 and p >= n - n % 4 then n % 4 else 4 end as bigint) as window_size, 1.0::double / case when n % 4 > 0 and p >= n - n % 4 then n % 4 else 4 end as scale, cast(ceil(n / 4) as bigint) as steps from r"""
)
def accumulation_schedule(spark, folder):
    w = Window.partitionBy("user_id")
    e = table(spark, folder, "events").select("event_id", (F.row_number().over(w.orderBy("event_id")) - 1).alias("p"), F.count(F.lit(1)).over(w).alias("n"))
    return batching.accumulation(e, "p", "n", 4).select("event_id", "optimizer_step", "window_size", "scale", batching.steps_per_epoch(F.col("n"), 4).alias("steps"))


def _byte_ids(x: str) -> str:
    bytes_ = f"list_transform(range(1, least(strlen({x}), 255) + 1), lambda k: cast('0x' || substring(hex(encode({x})), cast(2 * k - 1 as integer), 2) as integer) + 3)"
    return f"list_append({bytes_}, 1)"


def _said(ids: str) -> str:
    return f"array_to_string(list_transform({ids}, lambda v: cast(v as varchar)), ' ')"


_BYTES = f"""b as (select 'i' || test_id as id, cast(test_id // 8 as bigint) as batch, {_byte_ids("coalesce(transliteration, '')")} as s, {_byte_ids("coalesce(translation, '')")} as t from independent_test_set_clean
    union all select 'n' || test_id, cast(test_id // 8 as bigint) + 1000000000, {_byte_ids("coalesce(transliteration, '')")}, {_byte_ids("coalesce(translation, '')")} from new_test_set)"""
_PADDED = f"""{_said("list_concat(s, list_transform(range(0, a - len(s)), lambda k: 0))")} as input_ids, {_said("list_concat(list_transform(s, lambda v: 1), list_transform(range(0, a - len(s)), lambda k: 0))")} as attention_mask,
    {_said("list_concat(t, list_transform(range(0, b - len(t)), lambda k: -100))")} as labels"""


def _test_texts(spark, folder):
    """Both test sets with an id and a batch of their own."""
    out = None
    for mark, first, name in (("i", 0, "independent_test_set_clean"), ("n", 1_000_000_000, "new_test_set")):
        t = table(spark, folder, name).na.fill("", ["transliteration", "translation"])
        one = t.select(F.concat(F.lit(mark), "test_id").alias("id"), (F.floor(F.col("test_id") / 8) + first).alias("batch"), "transliteration", "translation")
        out = one if out is None else out.unionAll(one)
    return out


def _spoken(df):
    return df.withColumns({c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ") for c in ("input_ids", "attention_mask", "labels")})


@query(f"with {_BYTES} select id, {_PADDED} from (select *, 256 as a, 256 as b from b)")
def byte_tokenise_pad(spark, folder):
    out = batching.fixed_length(_test_texts(spark, folder), "transliteration", "translation", 256, 256)
    return _spoken(out).select("id", "input_ids", "attention_mask", "labels")


@query(f"with {_BYTES} select id, batch, {_PADDED} from (select *, max(len(s)) over (partition by batch) as a, max(len(t)) over (partition by batch) as b from b)")
def byte_tokenise_dynamic(spark, folder):
    out = batching.dynamic_length(_test_texts(spark, folder), "batch", "transliteration", "translation", 256, 256)
    return _spoken(out).select("id", "batch", "input_ids", "attention_mask", "labels")


# --- files -------------------------------------------------------------------

_MISSING = ", ".join(f"'{m}'" for m in readers.MISSING)
_CELL = lambda c: f"case when {c} in ({_MISSING}) then null else {c} end as {c}"


@query(f"select row_id, {', '.join(map(_CELL, ('transliteration', 'translation', 'oare_id', 'genre', 'source', 'alignment_method')))} from {CORPUS}")
def csv_prepared(spark, folder):
    """The corpus written as CSV and read back as a prepared table."""
    place = new_folder(spark, "csv")
    sinks.write_csv(table(spark, folder, CORPUS).drop("edited_at", "ingested_at"), place, quote_all=True)
    return readers.read_prepared(spark, place).select(F.col("row_id").cast("long").alias("row_id"), "transliteration", "translation", "oare_id", "genre", "source", "alignment_method")


@query(f"select {_CELL('word')}, {_CELL('definition')}, {_CELL('derived_from')} from ebl_dictionary")
def csv_dictionary(spark, folder):
    place = new_folder(spark, "csv")
    sinks.write_csv(table(spark, folder, "ebl_dictionary"), f"{place}/d.csv")
    return readers.read_dictionary(spark, place, "d.csv").select("word", "definition", "derived_from")


@query(f"select coalesce(entry_type, '') as type, coalesce(form, '') as form, coalesce(lexeme, '') as lexeme from oa_lexicon_ebl")
def csv_strings(spark, folder):
    """Read as strings, no cell is missing."""
    place = new_folder(spark, "csv")
    sinks.write_csv(table(spark, folder, "oa_lexicon_ebl"), place)
    return readers.read_strings(spark, place).select(F.col("entry_type").alias("type"), "form", "lexeme")


@query("select test_id, oare_id from new_test_set where oare_id is not null and trim(oare_id) <> '' and oare_id in (select oare_id from golden_corpus_v2_prefilt)")
def json_ids(spark, folder):
    """Ids of both tables written as one JSON list, read back and used as a filter."""
    place = f"{new_folder(spark, 'ids')}/held.json"
    ids = lambda t: table(spark, folder, t).select(F.col("oare_id").alias("id"))
    sinks.write_id_union(place, ids(CORPUS))
    return table(spark, folder, "new_test_set").join(readers.read_ids(spark, place, strict=True), F.trim("oare_id") == F.col("id"), "left_semi").select("test_id", "oare_id")


@query(
    """with e as (select *, row_number() over (partition by user_id, event_id % 2 order by event_id desc) as k from events), one as (select * from e where k = 1 and event_id % 2 = 0), two as (select * from e where k = 1 and event_id % 2 = 1)
    select user_id as run_id, event_type as status from two union all select user_id, event_type from one where user_id not in (select user_id from two)"""
)
def registry_file(spark, folder):
    """A registry written, read, and written again over itself with newer rows."""
    place = new_folder(spark, "registry")
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("ordinal"))
    full = lambda odd: metrics.best_rows(e.where(F.col("ordinal") % 2 == odd), "run_id", [F.desc("ordinal")]).select(*(F.col(c) if c in ("run_id", "status") else F.lit(None).cast("string").alias(c) for c in runs.REGISTRY))
    full(0).write.parquet(place)
    sinks.write_registry(spark.read.parquet(place), full(1), place)
    return spark.read.parquet(place).select(F.col("run_id").cast("long").alias("run_id"), "status")


@query("select row_number() over (order by test_id) - 1 as row, oare_id as doc_id, genre as prediction, transliteration, translation from new_test_set")
def references_attached(spark, folder):
    t = table(spark, folder, "new_test_set").withColumnRenamed("oare_id", "doc_id")
    said, held = t.select(F.col("test_id").alias("ordinal"), "doc_id", F.col("genre").alias("prediction")), t.select((F.col("test_id") * 3).alias("ordinal"), "doc_id", "transliteration", "translation")
    return readers.attach_references(said, held).select("row", "doc_id", "prediction", "transliteration", "translation")


_PAIRED = "transliteration is not null and translation is not null"
_GOOD = f"length(translation) >= 5 and greatest(length(transliteration), length(translation)) / greatest(1, least(length(transliteration), length(translation))) <= 10.0 and not regexp_matches(translation, '{S.METADATA}')"


@query(
    f"""with s as (select 0 as place, 'loaded' as stage, true as kept from {CORPUS} union all select 1, 'held_out', oare_id is null or not exists (select 1 from new_test_set t where t.oare_id = c.oare_id) from {CORPUS} c
    union all select 2, 'complete', {_PAIRED} from {CORPUS} c where oare_id is null or not exists (select 1 from new_test_set t where t.oare_id = c.oare_id)
    union all select 3, 'quality', {_GOOD} from {CORPUS} c where (oare_id is null or not exists (select 1 from new_test_set t where t.oare_id = c.oare_id)) and {_PAIRED})
    select place, stage, count_if(kept) as rows from s group by place, stage"""
)
def stage_counts(spark, folder):
    held = table(spark, folder, "new_test_set").select("oare_id")
    return pipeline.stage_counts(table(spark, folder, CORPUS), pipeline_defaults(filter_quality=True), held)
