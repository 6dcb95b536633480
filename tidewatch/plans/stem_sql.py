"""The language analysis of X3 as DuckDB SQL: a table of distinct words and their stems, by regular expressions.

Written apart from `functions.stemming` (which walks letters and rule tables in Python); both hold the same stop
words, which are fixed values.
"""

from __future__ import annotations

from tidewatch.functions.stemming import STOP

# consonant and vowel sequences, and stems with a syllable, exactly one, two or more, and with a vowel
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0, M1, M2, HAS_V = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?[aeiouy]"
CVC = f"^{_C}[aeiouy][^aeiouwxy]$"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


def _map(pairs: dict) -> str:
    return f"MAP {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{b}{chr(39)}' for a, b in pairs.items())}}}"


STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
         "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
         "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}


def _replaced(col: str, step: dict) -> str:
    end = f"regexp_extract({col}, '({'|'.join(step)})$')"  # the leftmost match is the longest suffix
    stem = f"left({col}, length({col}) - length({end}))"
    return f"CASE WHEN {end} <> '' AND regexp_matches({stem}, '{M0}') THEN {stem} || {_map(step)}[{end}] ELSE {col} END"


_EN_4 = "regexp_extract({0}, '(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|[st]ion|ou|ism|ate|iti|ous|ive|ize)$')"
_EN_CUT = _EN_4.format("g")
_EN_CUT = f"(CASE WHEN right({_EN_CUT}, 3) = 'ion' THEN 'ion' ELSE {_EN_CUT} END)"
EN_SQL = f"""
e0 AS (SELECT lang, word, CASE WHEN regexp_matches(word, '.[''’]s$') THEN left(word, -2) ELSE word END AS w FROM v WHERE lang = 'en'),
e1 AS (SELECT *, CASE WHEN regexp_matches(w, '(ss|i)es$') THEN left(w, -2) WHEN regexp_matches(w, '[^s]s$') THEN left(w, -1) ELSE w END AS a FROM e0),
e2 AS (SELECT *, CASE WHEN regexp_matches(a, 'eed$') THEN CASE WHEN regexp_matches(left(a, -3), '{M0}') THEN left(a, -1) ELSE a END ELSE a END AS b0,
              NOT regexp_matches(a, 'eed$') AND regexp_matches(a, '(ed|ing)$') AND regexp_matches(regexp_replace(a, '(ed|ing)$', ''), '{HAS_V}') AS cut FROM e1),
e3 AS (SELECT *, CASE WHEN cut THEN regexp_replace(a, '(ed|ing)$', '') ELSE b0 END AS b1 FROM e2),
e4 AS (SELECT *, CASE WHEN NOT cut THEN b1 WHEN regexp_matches(b1, '(at|bl|iz)$') THEN b1 || 'e'
              WHEN regexp_matches(b1, '[^aeiouylsz]$') AND right(b1, 1) = substr(b1, length(b1) - 1, 1) AND length(b1) > 1 THEN left(b1, -1)
              WHEN regexp_matches(b1, '{CVC}') THEN b1 || 'e' ELSE b1 END AS c0 FROM e3),
e5 AS (SELECT *, CASE WHEN regexp_matches(c0, 'y$') AND regexp_matches(left(c0, -1), '{HAS_V}') THEN left(c0, -1) || 'i' ELSE c0 END AS d FROM e4),
e6 AS (SELECT *, {_replaced('d', STEP2)} AS f FROM e5),
e7 AS (SELECT *, {_replaced('f', STEP3)} AS g FROM e6),
e8 AS (SELECT *, CASE WHEN {_EN_CUT} <> '' AND regexp_matches(left(g, length(g) - length({_EN_CUT})), '{M2}')
                      THEN left(g, length(g) - length({_EN_CUT})) ELSE g END AS h FROM e7),
e9 AS (SELECT *, CASE WHEN right(h, 1) = 'e' AND (regexp_matches(left(h, -1), '{M2}') OR regexp_matches(left(h, -1), '{M1}')
                      AND NOT regexp_matches(left(h, -1), '{CVC}')) THEN left(h, -1) ELSE h END AS i FROM e8),
en AS (SELECT lang, word, w, CASE WHEN length(w) < 3 THEN w WHEN regexp_matches(i, 'll$') AND regexp_matches(i, '{M2}') THEN left(i, -1) ELSE i END AS token FROM e9)"""

_FOLD = "translate({0}, 'àáâäòóôöèéêëùúûüìíîï', 'aaaaooooeeeeuuuuiiii')"
ES_SQL = f"""
s1 AS (SELECT lang, word, word AS w, {_FOLD.format('word')} AS a FROM v WHERE lang = 'es'),
es AS (SELECT lang, word, w, CASE WHEN length(w) < 5 THEN w WHEN regexp_matches(a, '[oae]$') THEN left(a, -1) WHEN regexp_matches(a, 'eses$') THEN left(a, -2)
              WHEN regexp_matches(a, 'ces$') THEN left(a, -3) || 'z' WHEN regexp_matches(a, '[oae]s$') THEN left(a, -2) ELSE a END AS token FROM s1)"""
_ELIDED_IT = "^(?:c|l|all|dall|dell|nell|sull|coll|pell|gl|agl|dagl|degl|negl|sugl|un|m|t|s|v|d)[''’](.)"
IT_SQL = f"""
i0 AS (SELECT lang, word, regexp_replace(word, '{_ELIDED_IT}', '\\1') AS w FROM v WHERE lang = 'it'),
i1 AS (SELECT *, {_FOLD.format('w')} AS a FROM i0),
it AS (SELECT lang, word, w, CASE WHEN length(w) < 6 THEN w WHEN regexp_matches(a, '([ih][ei]|i[ao])$') THEN left(a, -2)
              WHEN regexp_matches(a, '[aeio]$') THEN left(a, -1) ELSE a END AS token FROM i1)"""

_ELIDED_FR = "^(?:jusqu|quoiqu|lorsqu|puisqu|qu|[lmtnsjdc])[''’](.)"


def _ends(col: str, *rules: tuple[str, int, str]) -> str:
    """CASE over (ending, words longer than, new ending); NULL where none fits."""
    return "CASE " + " ".join(f"WHEN length({col}) > {n} AND suffix({col}, '{e}') THEN left({col}, {-len(e)}) || '{to}'" for e, n, to in rules) + " END"


FR_SQL = f"""
f0 AS (SELECT lang, word, regexp_replace(word, '{_ELIDED_FR}', '\\1') AS w FROM v WHERE lang = 'fr'),
f1 AS (SELECT *, CASE WHEN length(w) > 5 AND regexp_matches(w, '[^e]aux$') THEN left(w, -2) || 'l' WHEN length(w) > 5 AND suffix(w, 'x') THEN left(w, -1) ELSE w END AS a FROM f0),
f2 AS (SELECT *, CASE WHEN length(a) > 3 AND suffix(a, 'x') THEN left(a, -1) ELSE a END AS b FROM f1),
f3 AS (SELECT *, CASE WHEN length(b) > 3 AND suffix(b, 's') THEN left(b, -1) ELSE b END AS c FROM f2),
f4 AS (SELECT *, {_ends('c', ('issement', 9, 'ir'), ('issant', 8, 'ir'), ('ivement', 7, 'if'), ('ement', 6, 'e'), ('ficatrice', 11, 'fier'),
                       ('ficateur', 10, 'fier'), ('catrice', 9, 'quer'), ('cateur', 8, 'quer'), ('atrice', 8, 'er'), ('ateur', 7, 'er'))} AS d1 FROM f3),
f5 AS (SELECT *, coalesce({_ends('c', ('trice', 6, 'teur'))}, c) AS d FROM f4),
f6 AS (SELECT *, {_ends('d', ('ième', 5, ''), ('teuse', 7, 'ter'), ('teur', 6, 'ter'), ('euse', 5, 'eu'), ('ère', 8, 'er'), ('ive', 7, 'if'),
                       ('folle', 4, 'fou'), ('molle', 4, 'mou'), ('nnelle', 9, 'n'), ('nnel', 9, 'n'))} AS e1 FROM f5),
f7 AS (SELECT *, coalesce({_ends('d', ('ète', 4, 'et'))}, d) AS e FROM f6),
f8 AS (SELECT *, coalesce({_ends('e', ('ique', 8, ''))}, e) AS g FROM f7),
f9 AS (SELECT *, {_ends('g', ('esse', 8, 'e'), ('inage', 7, 'in'), ('ualisation', 12, 'uel'), ('isation', 9, ''), ('isateur', 9, ''), ('ation', 8, ''),
                       ('ition', 8, ''))} AS h1 FROM f8),
fa AS (SELECT *, coalesce(d1, e1, h1, g) AS h FROM f9),
fb AS (SELECT *, CASE WHEN length(h) > 4 THEN list_reduce(string_split(translate(h, 'àáâôèéêùûîç', 'aaaoeeeuuic'), ''),
              lambda x, y: CASE WHEN right(x, 1) = y AND regexp_matches(y, '\\p{{L}}') THEN x ELSE x || y END) ELSE h END AS k FROM fa),
fc AS (SELECT *, CASE WHEN length(k) > 4 AND suffix(k, 'ie') THEN left(k, -2) ELSE k END AS l FROM fb),
fd AS (SELECT *, CASE WHEN length(l) > 4 THEN regexp_replace(l, 'e?e?r?$', '') ELSE l END AS m FROM fc),
fr AS (SELECT lang, word, w, CASE WHEN length(l) > 4 AND length(m) > 1 AND right(m, 1) = substr(m, length(m) - 1, 1) AND regexp_matches(m, '\\p{{L}}$')
              THEN left(m, -1) ELSE m END AS token FROM fd)"""


def analyzed_sql(words: str, banned: str) -> str:
    """The relation (doc_id, text, lang, source, tokens) of `documents`; `words` is the SQL of a row's list of words."""
    stop = " ".join(f"WHEN '{lang}' THEN {_list(STOP[lang])}" for lang in STOP)
    return f"""(
WITH w AS (SELECT doc_id, lang, unnest(list_distinct({words})) AS word FROM documents),
v AS (SELECT DISTINCT lang, word FROM w),{EN_SQL},{ES_SQL},{IT_SQL},{FR_SQL},
stems AS (SELECT lang, word, w, token FROM en UNION ALL SELECT * FROM es UNION ALL SELECT * FROM it UNION ALL SELECT * FROM fr),
table_ AS (SELECT lang, word, CASE WHEN list_contains(CASE lang {stop} END, w) THEN NULL ELSE token END AS token FROM stems
           UNION ALL SELECT lang, word, word FROM v WHERE coalesce(lang, '') NOT IN ('en', 'es', 'fr', 'it')),
t AS (SELECT doc_id, list(DISTINCT token) AS tokens FROM w JOIN table_ ON w.word = table_.word AND w.lang IS NOT DISTINCT FROM table_.lang
      WHERE token IS NOT NULL AND length(trim(token)) > 1 AND NOT list_contains({banned}, token) GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.tokens, []) END AS tokens FROM documents d LEFT JOIN t USING (doc_id))"""
