"""DuckDB expressions that say the same as the column functions, for the SQL twins."""

from __future__ import annotations

from ..functions import text as T
from . import fixtures

WS = T.WS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*names: str, more: str = "") -> str:
    """``with`` clause that defines derived tables by name."""
    parts = [f"{n} as ({fixtures.duck(n)})" for n in names]
    return "with recursive " + ", ".join(parts + ([more] if more else []))


def strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def escape(c: str) -> str:
    return f"regexp_replace({c}, {q(T.META)}, '\\\\\\1', 'g')"


_ANY = (WS + "+").replace("\\", "\\\\")


def flexible(key: str) -> str:
    return f"concat('(?i)', regexp_replace({escape(strip(key))}, '{WS}', {q(_ANY)}, 'g'))"


def token(key: str) -> str:
    return f"concat('(?i)', regexp_replace({escape(strip(key))}, '{WS}+', {q(_ANY)}, 'g'))"


def spans(text: str, pattern: str) -> str:
    """list of {s, e}; the starts are sums of the lengths before."""
    parts, hits = f"string_split_regex({text}, {pattern})", f"regexp_extract_all({text}, {pattern})"
    total = lambda xs, upto: f"coalesce(list_sum(list_transform(({xs})[1:{upto}], lambda z: len(z))), 0)"
    start = f"({total(parts, 'i')} + {total(hits, 'i - 1')})::int"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'s': {start}, 'e': ({start} + len(({hits})[i]))::int}})"


def occurrences(needle: str, text: str) -> str:
    exact = spans(text, escape(needle))
    several = f"regexp_matches({strip(needle)}, '{WS}')"
    return f"list_sort(list_distinct(list_concat({exact}, case when {several} then {spans(text, token(needle))} else [] end)))"


def kept(text: str, entries: str) -> str:
    """Leftmost, then longest, then first by rank. ``entries``: list of {r, p, m}."""
    hits = f"list_transform({spans(text, 'entry.p')}, lambda s: {{'s': s.s, 'n': s.s - s.e, 'r': entry.r, 'e': s.e, 'm': entry.m}})"
    pooled = f"list_sort(flatten(list_transform({entries}, lambda entry: {hits})))"
    return (
        f"case when len(coalesce({pooled}, [])) = 0 then [] else list_reduce(list_transform({pooled}, lambda x: [x]), "
        "lambda a, x: case when x[1].s >= a[-1].e then list_concat(a, x) else a end) end"
    )


def fragments(text: str, k: str) -> str:
    """list of {text, is_mask} from kept spans."""
    before = f"{text}[case when i = 1 then 1 else {k}[i - 1].e + 1 end : {k}[i].s]"
    inner = f"flatten(list_transform(range(1, len({k}) + 1), lambda i: [{{'text': {before}, 'is_mask': false}}, {{'text': {k}[i].m, 'is_mask': true}}]))"
    tail = f"[{{'text': {text}[case when len({k}) = 0 then 1 else {k}[-1].e + 1 end :], 'is_mask': false}}]"
    return f"list_filter(list_concat({inner}, {tail}), lambda f: len(f.text) > 0)"


def glued(pieces: str) -> str:
    return f"coalesce(array_to_string(list_transform({pieces}, lambda f: f.text), ''), '')"


def dictionary(table: str) -> str:
    """(doc_id, d): a document's entries, the longest value first."""
    return (
        f"select doc_id, list({{'r': r, 'p': {flexible('original_text')}, 'm': mask}} order by r) as d from (select *, "
        f"row_number() over (partition by doc_id order by len(original_text) desc, ord) as r from {table} where regexp_matches(original_text, '{T.NOT_WS}')) group by doc_id"
    )


def label_cut(c: str) -> str:
    cut = strip(f"regexp_replace({strip(c)}, {q('(?i)' + T.LABEL_RE)}, '')")
    return f"case when len({cut}) > 0 then {cut} else {strip(c)} end"


_NO_NL = WS.replace(r"\t-\r", r"\t\x0b-\r")
QUOTE_FROM = T.QUOTES + T.DASHES + "№" + T.SPACES
QUOTE_TO = '"' * len(T.QUOTES) + "-" * len(T.DASHES) + "N" + " " * len(T.SPACES)


def n1(c: str) -> str:
    return f"translate({c}, {q(T.ZERO_WIDTH)}, '')"


def n2(c: str) -> str:
    return f"replace(translate({c}, {q(QUOTE_FROM)}, {q(QUOTE_TO)}), '…', '...')"


def n3(c: str) -> str:
    return f"regexp_replace({c}, '({T.WORD})-\\n({T.WORD})', '\\1\\2', 'g')"


def n4(c: str) -> str:
    right = f"regexp_replace({c}, '{_NO_NL}+(\\n|\\z)', '\\1', 'g')"
    once = lambda x: f"regexp_replace({x}, '([^.!?:;\\n])\\n([^\\n])', '\\1 \\2', 'g')"
    return once(once(right))


def n5(c: str) -> str:
    one = "len(list_filter(string_split(x, ' '), lambda p: len(p) = 1))"
    line = f"case when len(string_split(x, ' ')) >= 5 and {one} * 10 >= len(string_split(x, ' ')) * 6 then replace(x, ' ', '') else x end"
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: {line}), chr(10))"


def n6(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '{WS}+([,.;:!?])', '\\1', 'g')"


def n7(c: str) -> str:
    for step in (n1, n2, n3, n4, n5, n6):
        c = f"({step(c)})"
    return c


def n8(c: str) -> str:
    return strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def filled(template: str, **columns: str) -> str:
    parts, rest = [], template
    while marks := [(rest.find("{" + k + "}"), k) for k in columns if "{" + k + "}" in rest]:
        at, name = min(marks)
        parts += [q(rest[:at]), columns[name]]
        rest = rest[at + len(name) + 2 :]
    return "concat(" + ", ".join([*parts, q(rest)]) + ")"
