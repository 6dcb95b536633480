"""Language analysis of words (X3): elision, stop words and light stems for en, es, fr and it.

`analyzed(words, lang)` is an Arrow function over whole batches: words are stemmed once per distinct word and
language of a batch, nothing is shuffled. English uses Porter's algorithm, the others the published light
suffix rules for noun and adjective endings. Rules are tables of (suffix, words longer than, replacement); the first
suffix that fits decides. Other languages keep their words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Stop words. English is the analyzer's default list.
STOP_EN = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
# French stop words.
STOP_FR = frozenset(
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour "
    "qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant suis es est sommes "
    "êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes "
    "furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant eu eue eues eus ai as avons avez ont aurai auras "
    "aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait "
    "ayons ayez aient eusse eusses eût eussions eussiez eussent ceci cela celà cet cette ici ils les leurs quel quels quelle quelles sans soi".split())
# Spanish stop words without the forms of the four auxiliary verbs below.
_WORDS_ES = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin "
    "sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos "
    "qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te "
    "ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros "
    "nuestras vuestro vuestra vuestros vuestras esos esas "
    "estoy estás está estamos estáis están esté estés estemos estéis estén estaba estabas estábamos estabais estaban estuve estuviste estuvo "
    "estuvimos estuvisteis estuvieron he has ha hemos habéis han haya hayas hayamos hayáis hayan hube hubiste hubo hubimos hubisteis hubieron "
    "soy eres es somos sois son sea seas seamos seáis sean era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron tengo tienes "
    "tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan tuve tuviste tuvo tuvimos tuvisteis tuvieron")
# Italian stop words without the verb forms made below.
_WORDS_IT = (
    "ad al allo ai agli all agl alla alle con col coi da dal dallo dai dagli dall dagl dalla dalle di del dello dei degli dell degl della delle "
    "in nel nello nei negli nell negl nella nelle su sul sullo sui sugli sull sugl sulla sulle per tra contro io tu lui lei noi voi loro mio "
    "mia miei mie tuo tua tuoi tue suo sua suoi sue nostro nostra nostri nostre vostro vostra vostri vostre mi ti ci vi lo la li le gli ne il "
    "un uno una ma ed se perché anche come dov dove che chi cui non più quale quanto quanti quanta quante quello quelli quella quelle questo "
    "questi questa queste si tutto tutti a c e i l o ho hai ha abbiamo avete hanno abbia abbiate abbiano ebbi ebbe ebbero sono sei è siamo "
    "siete sia siate siano ero eri era eravamo eravate erano fui fu furono faccio fai facciamo fanno faccia facciate facciano feci fece "
    "fecero sto stai sta stiamo stanno stia stiate stiano stetti stette stettero avuto avuta avuti avute")


def _made(stems: str, endings: str) -> set[str]:
    return {s + e for s in stems.split() for e in endings.split()}


STOP_ES = frozenset(
    set(_WORDS_ES.split()) | _made("estar habr ser tendr", "é ás á emos éis án ía ías íamos íais ían") | _made("hab ten", "ía ías íamos íais ían iendo ido ida idos idas")
    | _made("estuv hub tuv", "iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen") | _made("fu", "era eras éramos erais eran ese eses ésemos eseis esen")
    | _made("est", "ando ado ada ados adas ad") | {"siendo", "sido", "tened"})
STOP_IT = frozenset(
    set(_WORDS_IT.split()) | _made("avr sar far star", "ò ai à emo ete anno ei esti ebbe emmo este ebbero") | _made("av fac", "evo evi eva evamo evate evano endo")
    | _made("st", "avo avi ava avamo avate avano ando") | _made("av fac", "esti emmo este essi esse essimo essero") | _made("fo", "sti mmo ste ssi sse ssimo ssero")
    | _made("st", "esti emmo este essi esse essimo essero") | {"essendo"})
# Elided articles and pronouns cut off before an apostrophe.
ELISIONS = {"fr": "l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split(),
            "it": "c l all dall dell nell sull coll pell gl agl dagl degl negl sugl un m t s v d".split()}
_ELIDED = {lang: re.compile(f"(?:{'|'.join(sorted(e, key=len, reverse=True))})['’](?=.)") for lang, e in ELISIONS.items()}

_PLAIN = str.maketrans("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii")
_PLAIN_FR = str.maketrans("àáâôèéêùûîç", "aaaoeeeuuic")


def stem_es(w: str) -> str:
    """Plural and gender endings of words of five letters or more; accents are dropped."""
    if len(w) < 5:
        return w
    w = w.translate(_PLAIN)
    if w[-1] in "oae":
        return w[:-1]
    if w.endswith("eses"):
        return w[:-2]
    if w.endswith("ces"):
        return w[:-3] + "z"
    return w[:-2] if w[-1] == "s" and w[-2] in "oae" else w


def stem_it(w: str) -> str:
    """Gender and number vowels of words of six letters or more; accents are dropped."""
    if len(w) < 6:
        return w
    w = w.translate(_PLAIN)
    before = {"e": "ih", "i": "hi", "a": "i", "o": "i"}.get(w[-1])
    if before is None:
        return w
    return w[:-2] if w[-2] in before else w[:-1]


# French rules (suffix, word longer than, replacement), first fit decides.
RULES_FR = (
    ("issement", 9, "ir"), ("issant", 8, "ir"), ("ivement", 7, "if"), ("ement", 6, "e"), ("ficatrice", 11, "fier"), ("ficateur", 10, "fier"),
    ("catrice", 9, "quer"), ("cateur", 8, "quer"), ("atrice", 8, "er"), ("ateur", 7, "er"), ("trice", 6, "teur>"), ("ième", 5, ""),
    ("teuse", 7, "ter"), ("teur", 6, "ter"), ("euse", 5, "eu"), ("ère", 8, "er"), ("ive", 7, "if"), ("folle", 4, "fou"), ("molle", 4, "mou"),
    ("nnelle", 9, "n"), ("nnel", 9, "n"), ("ète", 4, "et>"), ("ique", 8, ">"), ("esse", 8, "e"), ("inage", 7, "in"), ("ualisation", 12, "uel"),
    ("isation", 9, ""), ("isateur", 9, ""), ("ation", 8, ""), ("ition", 8, ""))


def stem_fr(w: str) -> str:
    """Plurals, derivational endings, then accents, doubled letters and final r and e. `>` in a rule goes on with later rules."""
    if len(w) > 5 and w[-1] == "x":
        w = w[:-2] + "l" if w.endswith("aux") and w[-4] != "e" else w[:-1]
    for last in "xs":
        if len(w) > 3 and w[-1] == last:
            w = w[:-1]
    for suffix, longer, to in RULES_FR:
        if len(w) > longer and w.endswith(suffix):
            w = w[:-len(suffix)] + to.rstrip(">")
            if not to.endswith(">"):
                break
    if len(w) > 4:
        w = re.sub(r"([^\W\d_])\1+", r"\1", w.translate(_PLAIN_FR))
    if len(w) > 4 and w.endswith("ie"):
        w = w[:-2]
    if len(w) > 4:
        w = w.removesuffix("r").removesuffix("e").removesuffix("e")
        if len(w) > 1 and w[-1] == w[-2] and w[-1].isalpha():
            w = w[:-1]
    return w


# Suffix rules of the English steps 2 and 3 (replacement if the stem has a syllable) and 4 (dropped if it has two).
RULES_EN = (
    (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
     ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
     ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")),
    (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
DROPPED_EN = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _sounds(w: str) -> str:
    """The word as v (vowels; y after a consonant too) and c."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _syllables(w: str) -> int:
    return len(re.findall("v+c", _sounds(w)))


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return _sounds(w).endswith("cvc") and w[-1] not in "wxy"


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _sounds(w)[-1] == "c"


def stem_en(w: str) -> str:
    """Porter's algorithm, for words of three letters or more."""
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((e for e in ("ed", "ing") if w.endswith(e)), "")
    if w.endswith("eed"):
        w = w[:-1] if _syllables(w[:-3]) else w
    elif cut and "v" in _sounds(w[:-len(cut)]):
        w = w[:-len(cut)]
        if w.endswith(("at", "bl", "iz")) or _syllables(w) == 1 and _short(w):
            w += "e"
        elif _doubled(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in _sounds(w[:-1]):
        w = w[:-1] + "i"
    for rules in RULES_EN:
        fit = max(((s, to) for s, to in rules if w.endswith(s)), key=lambda r: len(r[0]), default=None)
        if fit and _syllables(w[:-len(fit[0])]):
            w = w[:-len(fit[0])] + fit[1]
    drop = max((s for s in DROPPED_EN if w.endswith(s)), key=len, default="")
    drop = "ion" if drop in ("sion", "tion") else drop
    if drop and _syllables(w[:-len(drop)]) > 1:
        w = w[:-len(drop)]
    if w.endswith("e"):
        n = _syllables(w[:-1])
        if n > 1 or n == 1 and not _short(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _syllables(w) > 1 else w


STOP = {"en": STOP_EN, "es": STOP_ES, "fr": STOP_FR, "it": STOP_IT}
STEM = {"en": stem_en, "es": stem_es, "fr": stem_fr, "it": stem_it}


@lru_cache(maxsize=200_000)
def analyze(word: str, lang: str) -> str | None:
    """The token of a lower-case word in one of the four languages, None for a stop word."""
    if lang == "en":
        word = word[:-2] if len(word) > 2 and word[-2:] in ("'s", "’s") else word
    elif lang in _ELIDED:
        word = _ELIDED[lang].sub("", word, count=1) if _ELIDED[lang].match(word) else word
    return None if word in STOP[lang] else STEM[lang](word)


def _analyze_batch(words: pa.Array, lang: pa.Array) -> pa.Array:
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    known = [*coded.dictionary.to_pylist(), None]  # null words are dropped
    at = coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
    tokens = np.array([*known, None], object)[:-1][at]
    of_row = np.array([x if x in STOP else "" for x in lang.to_pylist()], object)
    of_word = np.repeat(of_row, size)
    for one in set(of_row) - {""}:
        mine = of_word == one
        table = np.empty(len(known), object)
        for i in np.unique(at[mine]):
            table[i] = None if known[i] is None else analyze(known[i], one)
        tokens[mine] = table[at[mine]]
    keep = np.array([t is not None for t in tokens], bool)
    bound = np.concatenate(([0], np.cumsum(size)))
    offsets = np.concatenate(([0], np.cumsum(keep)))[bound].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[keep], pa.string()), mask=words.is_null())


def analyzed(words: Column, lang: Column) -> Column:
    """Tokens of lower-case words (an array) by the row's language: elided articles and possessives cut, stop words out,
    stems of the rest, in order and with repetitions. Words of other or null languages stay; a null array stays null."""
    return F.arrow_udf(_analyze_batch, ArrayType(StringType()))(words, lang)
