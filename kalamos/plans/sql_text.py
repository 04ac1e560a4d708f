"""The normalisation steps once more, as SQL for an engine without look-around: the independent side of the checks."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD, NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def whitespace(x: str) -> str:
    return strip(sub(x, f"{WS}+", " "))


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def literal(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def minimal(x: str) -> str:
    return f"translate(nfc_normalize({x}), 'Ḫḫ₀₁₂₃₄₅₆₇₈₉ₓ', 'Hh0123456789x')"


def normalize(x: str, determinatives: bool = False, gaps: bool = False, tags: bool = False) -> str:
    x = f"translate({minimal(x)}, '!?/:„+', '')"
    x = literal(x, ("mup-", "ṭup-"), ("mup ", "ṭup "), ("aí", "ší"), ("aé", "šé"), ("aù", "šù"), ("aa", "ša"), ("au", "šu"))
    x = sub(x, f"([a-zA-ZàáèéìíòóùúšṭṣŠḪ])[0-9](-|{WS}|$)", r"\1\2")
    x = sub(x, r"\{([^}]+)\}", r"(\1)")
    x = sub(x, rf"(?i)\({WS}*(?:large{WS}+break|(?:\p{{Nd}}+{WS}+)?broken{WS}+(?:lines?|area)|break){WS}*\)", "<big_gap>")
    x = sub(x, "<<[^>]*>>", "")
    x = f"replace(replace({x}, '<gap>', chr(1)), '<big_gap>', chr(2))"
    x = f"replace(replace({sub(x, '<([^>]*)>', chr(92) + '1')}, chr(1), '<gap>'), chr(2), '<big_gap>')"
    x = sub(sub(x, r"\[\.\.\.[^\]]*\]|\.\.\.|…", "<big_gap>"), r"\[[xX]\]", "<gap>")
    for _ in range(2):  # neighbours share the character between them
        x = sub(x, f"(^|{NOT_WORD})x({NOT_WORD}|$)", r"\1<gap>\2")
    x = sub(x, r"\[([^\]x][^\]]*)\]", r"\1")
    x = f"translate({x}, '˹˺‹›⌈⌉', '')"
    if determinatives:
        x = sub(x, r"\{[a-zA-ZÀ-Ž₀-₉0-9]+\}|\([a-zA-ZÀ-Ž₀-₉0-9]+\)", "")
    if gaps:
        x = literal(x, ("<big_gap>", ""), ("<gap>", ""))
        for bare in ("big_gap", "gap"):
            for _ in range(2):
                x = sub(x, f"(^|{NOT_WORD}){bare}({NOT_WORD}|$)", r"\1\2")
    if tags:
        x = f"array_to_string(list_transform({words(x)}, lambda w: case when regexp_matches(w, '^[A-ZÀ-Ž][A-ZÀ-Ž0-9.\\-₀-₉]+$') then '<SUM>' || w || '</SUM>' else w end), ' ')"
    return whitespace(x)


def genre(x: str) -> str:
    text = f"lower({strip(f'''coalesce({x}, '')''')})"
    tag = sub(sub(f"case when {text} = 'nan' then '' else {text} end", "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return f"case when {tag} = '' then 'unknown' else {tag} end"


METADATA = (
    rf"(?i)^(?:\p{{Nd}}|[./:;,\-]|{WS})+$|^\(.*\)$|^col\.{WS}|^obv(?:$|{NOT_WORD})|^rev(?:$|{NOT_WORD})|^seal{WS}+impression"
    rf"|^\[+{WS}*\]+$|^broken$|^uninscribed$|^erased$|^rest broken|^traces|^too broken"
)


def tokens_13a(x: str) -> str:
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    x = literal(x, ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
    x = sub(f"(' ' || {x} || ' ')", r"([{-~\[-` -&(-+:-@/])", r" \1 ")
    x = sub(sub(x, r"([^0-9])([.,])", r"\1 \2 "), r"([.,])([^0-9])", r" \1 \2")
    return words(sub(x, r"([0-9])(-)", r"\1 \2 "))


def word_units(x: str) -> str:
    edge = r"[!-/:-@\[-`{-~]"
    one = f"case when length(w) > 1 and regexp_matches(w, '{edge}$') then [left(w, -1), right(w, 1)] when length(w) > 1 and regexp_matches(w, '^{edge}') then [left(w, 1), substring(w, 2)] else [w] end"
    return f"flatten(list_transform({words(x)}, lambda w: {one}))"


def list_grams(units: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({units}) - {n - 1}, 0) + 1), lambda i: array_to_string(({units})[i:i + {n - 1}], chr(1)))"


def char_grams(text: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({text}) - {n - 1}, 0) + 1), lambda i: substring({text}, i, {n}))"
