"""Snowball stemmers, written from the published descriptions of the algorithms.

`stemmer(language)` gives a function from a lower-case word to its stem. Vietnamese and names that no one knows
use English; "none" leaves words as they are. Languages of which the algorithm isn't written yet raise NotImplementedError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

WRITTEN = ("english", "german", "french", "spanish", "danish", "norwegian", "swedish", "italian", "portuguese", "dutch", "russian")
MISSING = ("arabic", "finnish", "greek", "hungarian", "romanian", "tamil", "turkish")
CODES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "da": "danish", "no": "norwegian", "nb": "norwegian", "sv": "swedish", "it": "italian", "italy": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian", "vi": "english", "vietnamese": "english"}


def language_name(name: str | None) -> str:
    """The language that a name or code means, in any case; English if none does."""
    low = (name or "").lower()
    low = CODES.get(low, low)
    return low if low in (*WRITTEN, *MISSING, "none") else "english"


def _ends(w: str, suffixes: Iterable[str]) -> str:
    """The longest of the suffixes that w ends in, or ""."""
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def _after(w: str, vowels: str, start: int = 0) -> int:
    """Where the region begins after the first non-vowel that follows a vowel."""
    i = start
    while i < len(w) and w[i] not in vowels:
        i += 1
    while i < len(w) and w[i] in vowels:
        i += 1
    return min(i + 1, len(w))


def _regions(w: str, vowels: str) -> tuple[int, int]:
    r1 = _after(w, vowels)
    return r1, _after(w, vowels, r1)


def _longest_first(words: str) -> tuple[str, ...]:
    return tuple(sorted(words.split(), key=len, reverse=True))


def _first(w: str, ordered: tuple[str, ...]) -> str:
    """Like `_ends` for suffixes in order of length."""
    return next((s for s in ordered if w.endswith(s)), "")


# English ------------------------------------------------------------------------------------------

_EN_V = "aeiouy"
_EN_FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_STOP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = _longest_first("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")


def _en_short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _EN_V and w[1] not in _EN_V
    return len(w) > 2 and w[-1] not in _EN_V + "wxY" and w[-2] in _EN_V and w[-3] not in _EN_V


def english(w: str) -> str:
    if len(w) <= 2:
        return w
    if w in _EN_FIXED:
        return _EN_FIXED[w]
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _EN_V and not (w[i - 1] == "y" and i == 1)) else c for i, c in enumerate(w))
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), 0)
    r1 = head or _after(w, _EN_V)
    r2 = _after(w, _EN_V, r1)
    w = w.removesuffix(_ends(w, ("'", "'s", "'s'")))
    s = _ends(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in _EN_V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_STOP:
        return w
    s = _ends(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _EN_V for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif _en_short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    s = _ends(w, _EN_2)
    if s and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if s == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif s == "li":
            w = stem if stem[-1:] and stem[-1] in "cdeghkmnrt" else w
        else:
            w = stem + _EN_2[s]
    s = _ends(w, _EN_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _EN_3[s]
    s = _first(w, _EN_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _en_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# German -------------------------------------------------------------------------------------------

_DE_V = "aeiouyäöü"


def _between(w: str, letters: str, vowels: str) -> str:
    """These letters, where they stand between vowels, in upper case."""
    return "".join(c.upper() if c in letters and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))


def german(w: str) -> str:
    w = _between(w.replace("ß", "ss"), "uy", _DE_V)
    r1, r2 = _regions(w, _DE_V)
    r1 = max(r1, min(3, len(w)))
    s = _ends(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1:
        if s == "s":
            w = w[:-1] if w[-2] in "bdfghklmnrt" else w
        else:
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    s = _ends(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _ends(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else stem
        elif s in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif s in ("lich", "heit"):
            w = stem[:-2] if stem.endswith(("er", "en")) and len(stem) - 2 >= r1 else stem
        else:
            more = _ends(stem, ("lich", "ig"))
            w = stem[: -len(more)] if more and len(stem) - len(more) >= r2 else stem
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")


# French -------------------------------------------------------------------------------------------

_FR_V = "aeiouyâàëéêèïîôûù"
_FR_1 = _longest_first(
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences "
    "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
)
_FR_2A = _longest_first("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_2B = _longest_first("ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR_2B_E = frozenset("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())


def _fr_marked(w: str) -> str:
    out = list(w)
    for i, c in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        vb, va = bool(before) and out[i - 1] in _FR_V, bool(after) and after in _FR_V
        if c in "ui" and vb and va or c == "y" and (vb or va) or c == "u" and before == "q":
            out[i] = c.upper()
    return "".join(out)


def _fr_rv(w: str) -> int:
    if w[:1] in _FR_V and w[1:2] in _FR_V and len(w) > 1 or w[:3] in ("par", "col", "tap"):
        return min(3, len(w))
    return next((i + 1 for i in range(1, len(w)) if w[i] in _FR_V), len(w))


def _fr_1(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word after the first step, and whether the verbs' endings are to be left alone."""
    s = _first(w, _FR_1)
    if not s:
        return w, False
    stem, at = w[: -len(s)], len(w) - len(s)
    if s in ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"):
        return (stem, True) if at >= r2 else (w, False)
    if s in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if at < r2:
            return w, False
        if stem.endswith("ic"):
            stem = stem[:-2] if at - 2 >= r2 else stem[:-2] + "iqU"
        return stem, True
    if s in ("logie", "logies"):
        return (stem + "log", True) if at >= r2 else (w, False)
    if s in ("usion", "ution", "usions", "utions"):
        return (stem + "u", True) if at >= r2 else (w, False)
    if s in ("ence", "ences"):
        return (stem + "ent", True) if at >= r2 else (w, False)
    if s in ("ement", "ements"):
        if at < rv:
            return w, False
        if stem.endswith("iv"):
            if at - 2 >= r2:
                stem = stem[:-2]
                if stem.endswith("at") and len(stem) - 2 >= r2:
                    stem = stem[:-2]
        elif stem.endswith("eus"):
            stem = stem[:-3] if at - 3 >= r2 else stem[:-3] + "eux" if at - 3 >= r1 else stem
        elif stem.endswith(("abl", "iqU")):
            stem = stem[:-3] if at - 3 >= r2 else stem
        elif stem.endswith(("ièr", "Ièr")):
            stem = stem[:-3] + "i" if at - 3 >= rv else stem
        return stem, True
    if s in ("ité", "ités"):
        if at < r2:
            return w, False
        if stem.endswith("abil"):
            stem = stem[:-4] if at - 4 >= r2 else stem[:-4] + "abl"
        elif stem.endswith("ic"):
            stem = stem[:-2] if at - 2 >= r2 else stem[:-2] + "iqU"
        elif stem.endswith("iv") and at - 2 >= r2:
            stem = stem[:-2]
        return stem, True
    if s in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return w, False
        if stem.endswith("at") and at - 2 >= r2:
            stem = stem[:-2]
            if stem.endswith("ic"):
                stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
        return stem, True
    if s == "eaux":
        return stem + "eau", True
    if s == "aux":
        return (stem + "al", True) if at >= r1 else (w, False)
    if s in ("euse", "euses"):
        return (stem, True) if at >= r2 else (stem + "eux", True) if at >= r1 else (w, False)
    if s in ("issement", "issements"):
        return (stem, True) if at >= r1 and stem[-1:] and stem[-1] not in _FR_V else (w, False)
    if s == "amment":
        return (stem + "ant", False) if at >= rv else (w, False)
    if s == "emment":
        return (stem + "ent", False) if at >= rv else (w, False)
    return (stem, False) if at - 1 >= rv and stem[-1] in _FR_V else (w, False)


def french(w: str) -> str:
    w = _fr_marked(w)
    rv, (r1, r2) = _fr_rv(w), _regions(w, _FR_V)
    w, done = _fr_1(w, rv, r1, r2)
    if not done:
        s = _first(w[rv:], _FR_2A)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in _FR_V:
            w, done = w[: -len(s)], True
    if not done:
        s = _first(w[rv:], _FR_2B)
        if s and (s != "ions" or len(w) - 4 >= r2):
            w, done = w[: -len(s)], True
            if s in _FR_2B_E and len(w) > rv and w.endswith("e"):
                w = w[:-1]
    if done:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        s = _ends(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if s == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif s == "e":
            w = w[:-1]
        elif s == "ë":
            w = w[:-1] if w.endswith("guë") else w
        elif s:
            w = w[: -len(s)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    i = len(w)
    while i > 0 and w[i - 1] not in _FR_V:
        i -= 1
    if 0 < i < len(w) and w[i - 1] in "éè":
        w = w[: i - 1] + "e" + w[i:]
    return w.lower()


# Spanish ------------------------------------------------------------------------------------------

_ES_V = "aeiouáéíóúü"
_ES_PRONOUN = _longest_first("me se sela selo selas selos la le lo las les los nos")
_ES_1 = _longest_first(
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos "
    "adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos"
)
_ES_2A = _longest_first("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_2B = _longest_first(
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis "
    "ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _romance_rv(w: str, vowels: str) -> int:
    """Spanish, Portuguese and Italian: the region RV."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def spanish(w: str) -> str:
    rv, (r1, r2) = _romance_rv(w, _ES_V), _regions(w, _ES_V)
    s = _first(w, _ES_PRONOUN)
    if s:
        stem = w[: -len(s)]
        verb = _ends(stem[rv:], ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = stem[: -len(verb)] + verb.translate(_ACUTE)
        elif verb and (verb != "yendo" or stem[: -len(verb)].endswith("u")):
            w = stem
    before = w
    s = _first(w, _ES_1)
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s == "amente":
            if at >= r1:
                w = stem
                more = _ends(w, ("iv", "os", "ic", "ad"))
                if more and len(w) - 2 >= r2:
                    w = w[:-2]
                    if more == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif at >= r2:
            w = stem
            if s in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
                more = _ends(w, ("ic",))
            elif s in ("logía", "logías"):
                w, more = w + "log", ""
            elif s in ("ución", "uciones"):
                w, more = w + "u", ""
            elif s in ("encia", "encias"):
                w, more = w + "ente", ""
            elif s == "mente":
                more = _ends(w, ("ante", "able", "ible"))
            elif s in ("idad", "idades"):
                more = _ends(w, ("abil", "ic", "iv"))
            elif s in ("iva", "ivo", "ivas", "ivos"):
                more = _ends(w, ("at",))
            else:
                more = ""
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    if w == before:
        s = _first(w[rv:], _ES_2A)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _first(w[rv:], _ES_2B)
            if s:
                w = w[: -len(s)]
                if s in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    s = _ends(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


# Danish, Norwegian, Swedish -----------------------------------------------------------------------

_NORTH_V = {"da": "aeiouyæåø", "no": "aeiouyæåø", "sv": "aeiouyäåö"}
_NORTH_1 = {
    "da": _longest_first("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s"),
    "no": _longest_first("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert"),
    "sv": _longest_first("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s"),
}
_NORTH_S = {"da": "abcdfghjklmnoprtvyzå", "no": "bcdfghjlmnoprtvyz", "sv": "bcdfghjklmnoprtvy"}


def _north(w: str, kind: str) -> tuple[str, int]:
    v = _NORTH_V[kind]
    r1 = max(_after(w, v), min(3, len(w)))
    s = _first(w[r1:], _NORTH_1[kind])
    if s == "s":
        b = w[-2:-1]
        if b and (b in _NORTH_S[kind] or kind == "no" and b == "k" and w[-3:-2] and w[-3] not in v):
            w = w[:-1]
    elif s in ("erte", "ert") and kind == "no":
        w = w[: -len(s)] + "er"
    elif s:
        w = w[: -len(s)]
    return w, r1


def danish(w: str) -> str:
    w, r1 = _north(w, "da")

    def pair(x: str) -> str:
        return x[:-1] if _ends(x[r1:], ("gd", "dt", "gt", "kt")) else x

    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    s = _ends(w[r1:], ("ig", "lig", "elig", "els", "løst"))
    if s == "løst":
        w = w[:-1]
    elif s:
        w = pair(w[: -len(s)])
    if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in _NORTH_V["da"]:
        w = w[:-1]
    return w


def norwegian(w: str) -> str:
    w, r1 = _north(w, "no")
    if _ends(w[r1:], ("dt", "vt")):
        w = w[:-1]
    s = _ends(w[r1:], ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))
    return w[: -len(s)] if s else w


def swedish(w: str) -> str:
    w, r1 = _north(w, "sv")
    if _ends(w[r1:], ("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    s = _ends(w[r1:], ("lig", "ig", "els", "löst", "fullt"))
    return w[:-1] if s in ("löst", "fullt") else w[: -len(s)] if s else w


# Italian ------------------------------------------------------------------------------------------

_IT_V = "aeiouàèìòù"
_IT_PRONOUN = _longest_first("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_1 = _longest_first(
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti azione azioni atore atori logia logie uzione uzioni usione usioni enza enze "
    "amento amenti imento imenti amente ità ivo ivi iva ive"
)
_IT_2 = _longest_first(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo "
    "Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(w: str) -> str:
    w = w.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = _between(w, "ui", _IT_V)
    rv, (r1, r2) = _romance_rv(w, _IT_V), _regions(w, _IT_V)
    s = _first(w, _IT_PRONOUN)
    if s:
        stem = w[: -len(s)]
        verb = _ends(stem[rv:], ("ando", "endo", "ar", "er", "ir"))
        if verb in ("ando", "endo"):
            w = stem
        elif verb:
            w = stem + "e"
    before = w
    s = _first(w, _IT_1)
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s == "amente":
            if at >= r1:
                w = stem
                more = _ends(w, ("iv", "os", "ic", "abil"))
                if more and len(w) - len(more) >= r2:
                    w = w[: -len(more)]
                    if more == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif s in ("amento", "amenti", "imento", "imenti"):
            w = stem if at >= rv else w
        elif at >= r2:
            w = stem
            if s in ("azione", "azioni", "atore", "atori"):
                w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
            elif s in ("logia", "logie"):
                w += "log"
            elif s in ("uzione", "uzioni", "usione", "usioni"):
                w += "u"
            elif s in ("enza", "enze"):
                w += "ente"
            elif s == "ità":
                more = _ends(w, ("abil", "ic", "iv"))
                w = w[: -len(more)] if more and len(w) - len(more) >= r2 else w
            elif s in ("ivo", "ivi", "iva", "ive") and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
    if w == before:
        s = _first(w[rv:], _IT_2)
        w = w[: -len(s)] if s else w
    if len(w) > rv and w[-1] in "aeioàèìò":
        w = w[:-1]
        if len(w) > rv and w.endswith("i"):
            w = w[:-1]
    if len(w) > rv and w.endswith(("ch", "gh")):
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


# Portuguese ---------------------------------------------------------------------------------------

_PT_V = "aeiouáéíóúâêô"
_PT_1 = _longest_first(
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras"
)
_PT_2 = _longest_first(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(w: str) -> str:
    w = w.replace("ã", "a~").replace("õ", "o~")
    rv, (r1, r2) = _romance_rv(w, _PT_V), _regions(w, _PT_V)
    before = w
    s = _first(w, _PT_1)
    if s:
        stem, at = w[: -len(s)], len(w) - len(s)
        if s == "amente":
            if at >= r1:
                w = stem
                more = _ends(w, ("iv", "os", "ic", "ad"))
                if more and len(w) - 2 >= r2:
                    w = w[:-2]
                    if more == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
        elif s in ("ira", "iras"):
            w = stem + "ir" if at >= rv and stem.endswith("e") else w
        elif at >= r2:
            w = stem
            more = ""
            if s in ("logia", "logias"):
                w += "log"
            elif s in ("uça~o", "uço~es"):
                w += "u"
            elif s in ("ência", "ências"):
                w += "ente"
            elif s == "mente":
                more = _ends(w, ("ante", "avel", "ível"))
            elif s in ("idade", "idades"):
                more = _ends(w, ("abil", "ic", "iv"))
            elif s in ("iva", "ivo", "ivas", "ivos"):
                more = _ends(w, ("at",))
            w = w[: -len(more)] if more and len(w) - len(more) >= r2 else w
    if w == before:
        s = _first(w[rv:], _PT_2)
        w = w[: -len(s)] if s else w
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s = _ends(w[rv:], ("os", "a", "i", "o", "á", "í", "ó"))
        w = w[: -len(s)] if s else w
    s = _ends(w[rv:], ("e", "é", "ê"))
    if s:
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv or w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# Dutch --------------------------------------------------------------------------------------------

_NL_V = "aeiouyè"


def dutch(w: str) -> str:
    w = w.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    out = list(w)
    for i, c in enumerate(out):
        if c == "y" and (i == 0 or out[i - 1] in _NL_V):
            out[i] = "Y"
        elif c == "i" and 0 < i < len(out) - 1 and out[i - 1] in _NL_V and out[i + 1] in _NL_V:
            out[i] = "I"
    w = "".join(out)
    r1, r2 = _regions(w, _NL_V)
    r1 = max(r1, min(3, len(w)))

    def undouble(x: str) -> str:
        return x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def drop_en(x: str, n: int) -> str:
        stem = x[:-n]
        if len(stem) >= r1 and stem and stem[-1] not in _NL_V and not stem.endswith("gem"):
            return undouble(stem)
        return x

    s = _ends(w, ("heden", "en", "ene", "s", "se"))
    if s == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif s in ("en", "ene"):
        w = drop_en(w, len(s))
    elif s and len(w) - len(s) >= r1 and w[: -len(s)] and w[-len(s) - 1] not in _NL_V + "j":
        w = w[: -len(s)]
    removed_e = False
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _NL_V:
        w, removed_e = undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = drop_en(w, 2)
    s = _ends(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        stem = w[: -len(s)]
        if s in ("end", "ing"):
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else undouble(stem)
        elif s == "ig":
            w = w if stem.endswith("e") else stem
        elif s == "lijk":
            w = stem
            if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _NL_V:
                w = undouble(w[:-1])
        elif s == "baar":
            w = stem
        elif removed_e:
            w = stem
    if len(w) >= 4 and w[-1] not in _NL_V + "I" and w[-2] == w[-3] and w[-2] in "aeou" and w[-4] not in _NL_V:
        w = w[:-2] + w[-1]
    return w.lower()


# Russian ------------------------------------------------------------------------------------------

_RU_V = "аеиоуыэюя"
_RU_GERUND_1, _RU_GERUND_2 = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_RU_ADJ = _longest_first("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PART_1, _RU_PART_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_RU_VERB_1 = _longest_first("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно")
_RU_VERB_2 = _longest_first("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_NOUN = _longest_first("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def russian(w: str) -> str:
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_V), len(w))
    _, r2 = _regions(w, _RU_V)

    def cut(x: str, after_a: Iterable[str], free: Iterable[str]) -> str | None:
        """x without the longest of the endings; those of the first kind must follow а or я."""
        s = _ends(x[rv:], (*after_a, *free))
        if not s or s in after_a and s not in free and x[rv : len(x) - len(s)][-1:] not in ("а", "я"):
            return None
        return x[: -len(s)]

    done = cut(w, _RU_GERUND_1, _RU_GERUND_2)
    if done is None:
        s = _ends(w[rv:], ("ся", "сь"))
        w = w[: -len(s)] if s else w
        done = cut(w, (), _RU_ADJ)
        if done is not None:
            done = cut(done, _RU_PART_1, _RU_PART_2) or done
        else:
            done = cut(w, _RU_VERB_1, _RU_VERB_2)
            if done is None:
                done = cut(w, (), _RU_NOUN)
    w = done if done is not None else w
    w = w[:-1] if len(w) > rv and w.endswith("и") else w
    s = _ends(w, ("ост", "ость"))
    w = w[: -len(s)] if s and len(w) - len(s) >= r2 else w
    s = _ends(w[rv:], ("ейш", "ейше", "нн", "ь"))
    if s in ("ейш", "ейше"):
        w = w[: -len(s)]
        w = w[:-1] if w[rv:].endswith("нн") else w
    elif s == "нн":
        w = w[:-1]
    elif s == "ь":
        w = w[:-1]
    return w


_ALL: dict[str, Callable[[str], str]] = {n: globals()[n] for n in WRITTEN} | {"none": str}


@lru_cache(64)
def stemmer(language: str | None) -> Callable[[str], str]:
    """The stemmer of a language, which remembers the words that it has met lately."""
    name = language_name(language)
    if name not in _ALL:
        raise NotImplementedError(f"there is no stemmer for {name} yet")
    return lru_cache(200_000)(_ALL[name])
