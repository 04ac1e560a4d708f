"""SQL for the pN_ queries that SQL can express on whole tables.

Its table of look-alikes is written by hand and holds what the given tables use; the operators read theirs from
Unicode's data.  What both share are the lists of brackets, hyphens and fillers, which are stated facts of the task."""

from __future__ import annotations

import unicodedata

from kalamos.llm.lookalike import BRACKETS, BRAILLE_BLANK, FILLERS, HYPHENS, LOWERED

# Letters and the ASCII letters they look like.
LETTERS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳνοϲАВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏүՍՏՕօսոհցɑɡɩʏαρσЬі", "ABEZHIKMNOPTYXCjvocABESIJKMHOPCTYXYGQWaesijopcyxhdqwlyUSOounhgagiyapobi")


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = dict(zip(map(ord, LETTERS[0]), LETTERS[1], strict=True))
    table |= {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)}
    table |= dict.fromkeys(map(ord, HYPHENS), "-")
    for cp in (*range(0x80, 0x10000), *range(0xE0000, 0xE0080), 0x110BD, 0x110CD, *range(0x1D173, 0x1D17B)):
        if unicodedata.category(chr(cp)) in ("Cf", "Zs"):
            table[cp] = " " if unicodedata.category(chr(cp)) == "Zs" else None
    table |= {cp: None for cp in (*range(1, 9), *range(0xE, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0), *map(ord, FILLERS), *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))}
    return table | {ord(BRAILLE_BLANK): " "}


LOOKALIKE = _table()
PLAIN = LOOKALIKE | dict.fromkeys(map(ord, BRACKETS + "!?！？［］｛｝（）＜＞")) | {ord(a): b for a, b in zip(*LOWERED, strict=True)}

CORPUS = "golden_corpus_v2_prefilt"
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _translate(x: str, table: dict[int, str | None]) -> str:
    """Character by character on the composed text; removed characters stand last."""
    quote = lambda s: s.replace("'", "''")
    kept = {c: t for c, t in table.items() if t is not None and len(t) == 1}
    gone = [c for c, t in table.items() if t is None and c > 0]
    return f"nfc_normalize(translate({x}, '{quote(''.join(map(chr, [*kept, *gone])))}', '{quote(''.join(kept.values()))}'))"


def one_form(x: str) -> str:
    return _translate(x, LOOKALIKE)


def pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def plain_words(x: str) -> str:
    return f"list_filter(list_transform({pieces('lower(' + _translate(x, PLAIN) + ')')}, lambda w: regexp_replace(w, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')), lambda w: w <> '')"


def _bag(table: str, key: str, column: str) -> str:
    return f"select id, w, count(*) as n from (select {key} as id, unnest({plain_words(column)}) as w from {table}) group by id, w"


def _share(name: str, one: str, two: str, distinct: str = "true") -> str:
    """Tables ``name``: pairs that share a word, with their common share."""
    return f"""{name} as (select a, b, 2.0 * common / (x.n + y.n) as share from (select p.id as a, q.id as b, sum(least(p.n, q.n)) as common from {one} p join {two} q using (w) where {distinct} group by 1, 2)
      join (select id, sum(n) as n from {one} group by id) x on x.id = a join (select id, sum(n) as n from {two} group by id) y on y.id = b)"""


_TABLET = r"""case when trim({x}) = '' then null when length(regexp_replace({run}, '[^0-9a-fA-F]', '', 'g')) = 32 then
    regexp_replace(lower(regexp_replace({run}, '[^0-9a-fA-F]', '', 'g')), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') else {x} end"""


def tablet(x: str) -> str:
    found = rf"regexp_extract(' ' || {x} || ' ', '(?i)[^0-9a-z]((?:[0-9a-f][^0-9a-z]*){{31}}[0-9a-f])[^0-9a-z]', 1)"
    return _TABLET.format(x=x, run=f"coalesce(nullif({found}, ''), {x})")


_TERMS = f"""n as (select count(*) as n from {CORPUS} where transliteration <> ''), t as (select row_id, unnest({pieces(one_form('transliteration'))}) as term from {CORPUS} where transliteration <> ''),
    c as (select term, count(*) as occurrences, count(distinct row_id) as records from t group by term),
    m as (select term, occurrences, records, case when records < 3 then 'rare' when records > 0.2 * (select n from n) then 'common' end as mark from c)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with c as ({_bag(CORPUS, 'row_id', 'transliteration')}), i as ({_bag('independent_test_set_clean', 'test_id', 'transliteration')}), t as ({_bag('new_test_set', 'test_id', 'transliteration')}),
      {_share('one', 'i', 'c')}, {_share('two', 't', 'c')}
      select 'independent' as split, a as test_id, b as row_id from one where share >= 0.75 union all select 'newtest', a, b from two where share >= 0.75""",
    "p2_found": f"with {_TERMS} select term, mark from m where mark is not null",
    "p2_counts": f"with {_TERMS} select * from m",
    "p2_changes": f"""with f as (select row_id, case when edited_at >= timestamp '2024-01-01' then translation else transliteration end as x from {CORPUS} where genre is not null),
      t as (select row_id, unnest({pieces(one_form('x'))}) as term from f where x <> '') select term, count(*) as occurrences, count(distinct row_id) as records from t group by term""",
    "p3_found": f"""with recursive w as (select distinct id_written, {tablet('id_written')} as id from (select oare_id as id_written from {CORPUS} union select doc_id from sentence_pairs) where id_written is not null and trim(id_written) <> ''),
      e as (select {tablet('left_id')} as a, {tablet('right_id')} as b from tablet_joins where left_id is not null and right_id is not null), s as (select a, b from e union select b, a from e),
      r(id, other) as (select distinct a, a from s union select r.id, s.b from r join s on s.a = r.other), g as (select id, min(other) as grp from r group by id),
      x as (select id_written, coalesce(grp, w.id) as group_id from w left join g using (id))
      select id_written, group_id from (select *, count(*) over (partition by group_id) as n from x) where n >= 2""",
    "p3_shares": "select distinct split, true as within, 0 as torn from split_targets where split is not null and share > 0",
    "p4_found": f"""with s as ({_bag(CORPUS, 'row_id', 'transliteration')}), t as ({_bag(CORPUS, 'row_id', 'translation')}), hs as (select distinct id from s), ht as (select distinct id from t),
      {_share('one', 's', 's', 'p.id < q.id')}, {_share('two', 't', 't', 'p.id < q.id')},
      f1 as (select a, b from one where share >= 0.75 and (exists (select 1 from two where two.a = one.a and two.b = one.b and two.share >= 0.75) or one.a not in (select id from ht) or one.b not in (select id from ht))),
      f2 as (select a, b from two where share >= 0.75 and (a not in (select id from hs) or b not in (select id from hs)))
      select a as row_id_a, b as row_id_b from f1 union select a, b from f2""",
    "p5_found": f"""with f as (select row_id, transliteration as x, {one_form('transliteration')} as f from {CORPUS} where transliteration <> '')
      select a.row_id as row_id_a, b.row_id as row_id_b from f a join f b on a.f = b.f and a.row_id < b.row_id and a.x <> b.x""",
    "p5_groups": f"""with f as (select row_id, transliteration as x, {one_form('transliteration')} as f from {CORPUS} where transliteration <> ''),
      g as (select f, min(row_id) as class_id, count(distinct x) as forms, count(*) as rows from f group by f having count(distinct x) > 1) select row_id, class_id, forms, rows from f join g using (f)""",
    "p5_one_form": f"select row_id, {one_form('transliteration')} as one_form from {CORPUS}",
    "p9_found": """with t as (select doc_id, text from documents where length(text) >= 300), s as (select distinct doc_id, hash(substring(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from t)),
      m as (select h from s group by h having count(*) > 1), k as (select s.* from s join m using (h))
      select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from k a join k b on a.h = b.h and a.doc_id < b.doc_id""",
}
