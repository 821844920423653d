"""Stemmers of the Snowball family, from their published descriptions. Endings, letters and regions are fixed values.

R1 is what follows the first consonant after a vowel, R2 the same within R1, RV a region of its own for each language.
"""

from __future__ import annotations

import re
from collections.abc import Callable


def _after(w: str, vowels: str, start: int = 0) -> int:
    """Where what follows the first consonant after a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i - 1] in vowels and w[i] not in vowels:
            return i + 1
    return len(w)


def _regions(w: str, vowels: str, least: int = 0) -> tuple[int, int]:
    r1 = _after(w, vowels)
    return max(r1, min(least, len(w))), _after(w, vowels, r1)


def _rv(w: str, vowels: str) -> int:
    """RV of Spanish, Italian and Portuguese."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def _end(w: str, endings: str, region: int = 0) -> str:
    """The longest of the endings that lies in the region."""
    return max((e for e in endings.split() if w.endswith(e) and len(w) - len(e) >= region), key=len, default="")


def _cut(w: str, endings: str, region: int) -> str:
    return w[: len(w) - len(_end(w, endings, region))]


def _upper_between(w: str, letters: str, vowels: str) -> str:
    """Letters between two vowels count as consonants, and are written large."""
    out = list(w)
    for i in range(1, len(w) - 1):
        if w[i] in letters and out[i - 1] in vowels and w[i + 1] in vowels:
            out[i] = w[i].upper()
    return "".join(out)


def _rules(w: str, table: list[tuple[str, Callable]], region: int = 0) -> str | None:
    """Applies the rule of the longest ending in any of the rows; None if that changes nothing."""
    found = [(e, act) for endings, act in table if (e := _end(w, endings, region))]
    if not found:
        return None
    ending, act = max(found, key=lambda x: len(x[0]))
    out = act(w[: len(w) - len(ending)], ending)
    return None if out == w else out


# --- Germanic languages ----------------------------------------------------------------------------------------------


def danish(w: str) -> str:
    vowels = "aeiouyæåø"
    r1, _ = _regions(w, vowels, 3)
    e = _end(w, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s", r1)
    if e and (e != "s" or w[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        w = w[: -len(e)]
    pair = lambda x: x[:-1] if _end(x, "gd dt gt kt", r1) else x
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    e = _end(w, "ig lig elig els løst", r1)
    if e == "løst":
        w = w[:-1]
    elif e:
        w = pair(w[: -len(e)])
    return w[:-1] if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in vowels else w


def norwegian(w: str) -> str:
    vowels = "aeiouyæåø"
    r1, _ = _regions(w, vowels, 3)
    e = _end(w, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert", r1)
    if e in ("erte", "ert"):
        w = w[: -len(e)] + "er"
    elif e and (e != "s" or w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (w[-2:-1] == "k" and w[-3:-2] not in (*vowels, ""))):
        w = w[: -len(e)]
    if _end(w, "dt vt", r1):
        w = w[:-1]
    return _cut(w, "leg eleg ig eig lig elig els lov elov slov hetslov", r1)


def swedish(w: str) -> str:
    vowels = "aeiouyåäö"
    r1, _ = _regions(w, vowels, 3)
    e = _end(w, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s", r1)
    if e and (e != "s" or w[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        w = w[: -len(e)]
    if _end(w, "dd gd nn dt gt kt tt", r1):
        w = w[:-1]
    e = _end(w, "lig ig els löst fullt", r1)
    return w[:-1] if e in ("löst", "fullt") else w[: len(w) - len(e)]


def german(w: str) -> str:
    vowels = "aeiouyäöü"
    w = _upper_between(w.replace("ß", "ss"), "uy", vowels)
    r1, r2 = _regions(w, vowels, 3)
    e = _end(w, "em ern er e en es s", r1)
    if e == "s":
        w = w[:-1] if w[-2:-1] in tuple("bdfghklmnrt") else w
    elif e:
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _end(w, "en er est st", r1)
    if e == "st":
        w = w[:-2] if w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6 else w
    else:
        w = w[: len(w) - len(e)]
    e = _end(w, "end ung ig ik isch lich heit keit", r2)
    if e and not (e in ("ig", "ik", "isch") and w[: -len(e)].endswith("e")):
        w = w[: -len(e)]
        if e in ("end", "ung") and _end(w, "ig", r2) and not w.endswith("eig"):
            w = w[:-2]
        elif e in ("lich", "heit"):
            w = _cut(w, "er en", r1)
        elif e == "keit":
            w = _cut(w, "lich ig", r2)
    return w.lower().translate(str.maketrans("äöü", "aou"))


def dutch(w: str) -> str:
    vowels = "aeiouyè"
    w = w.translate(str.maketrans("äáëéïíöóüú", "aaeeiioouu"))
    w = _upper_between(re.sub(r"(^|[aeiouyè])y", lambda m: m[1] + "Y", w), "i", vowels)
    r1, r2 = _regions(w, vowels, 3)
    undouble = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def without_en(x: str, e: str) -> str:
        s = x[: -len(e)]
        return undouble(s) if s and s[-1] not in vowels and not s.endswith("gem") else x

    e = _end(w, "heden en ene s se", r1)
    if e == "heden":
        w = w[:-5] + "heid"
    elif e in ("en", "ene"):
        w = without_en(w, e)
    elif e and w[: -len(e)] and w[-len(e) - 1] not in vowels + "j":
        w = w[: -len(e)]

    def without_e(x: str) -> str:
        return undouble(x[:-1]) if _end(x, "e", r1) and x[-2:-1] not in (*vowels, "") else x

    before, w = w, without_e(w)
    had_e = w != before
    if _end(w, "heid", r2) and w[-5:-4] != "c":
        w = w[:-4]
        if _end(w, "en", r1):
            w = without_en(w, "en")
    e = _end(w, "end ing ig lijk baar bar", r2)
    if e in ("end", "ing"):
        w = w[:-3]
        w = w[:-2] if _end(w, "ig", r2) and not w.endswith("eig") else undouble(w)
    elif e == "ig":
        w = w[:-2] if not w.endswith("eig") else w
    elif e == "lijk":
        w = without_e(w[:-4])
    elif e == "baar" or (e == "bar" and had_e):
        w = w[: -len(e)]
    if re.search(r"[^aeiouyè](aa|ee|oo|uu)[^aeiouyèI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


# --- Romance languages ----------------------------------------------------------------------------------------------


def spanish(w: str) -> str:
    vowels = "aeiouáéíóúü"
    rv, (r1, r2) = _rv(w, vowels), _regions(w, vowels)
    plain = str.maketrans("áéíóú", "aeiou")
    e = _end(w, "me se sela selo selas selos la le lo las les los nos", rv)
    if e:
        s = w[: -len(e)]
        if _end(s, "iéndo ándo ár ér ír", rv):
            n = len(_end(s, "iéndo ándo ár ér ír", rv))
            w = s[:-n] + s[-n:].translate(plain)
        elif _end(s, "ando iendo ar er ir", rv) or (_end(s, "yendo", rv) and s.endswith("uyendo")):
            w = s

    def before(*more: str) -> Callable:
        """Deletes in R2; then what may stand before, in turn."""
        return lambda s, e: s + e if len(s) < r2 else next((s[: -len(x)] for x in more if s.endswith(x) and len(s) - len(x) >= r2), s)

    def adverb(s: str, e: str) -> str:
        if len(s) < r1:
            return s + e
        if _end(s, "iv", r2):
            return _cut(s[:-2], "at", r2)
        return _cut(s, "os ic ad", r2)

    put = lambda new: lambda s, e: s + new if len(s) >= r2 else s + e
    new = _rules(w, [
        ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", before()),
        ("adora ador ación adoras adores aciones ante antes ancia ancias", before("ic")), ("logía logías", put("log")), ("ución uciones", put("u")), ("encia encias", put("ente")),
        ("amente", adverb), ("mente", before("ante", "able", "ible")), ("idad idades", before("abil", "ic", "iv")), ("iva ivo ivas ivos", before("at")),
    ])
    if new is None:
        e = _end(w, "ya ye yan yen yeron yendo yo yó yas yes yais yamos", rv)
        if e and w[: -len(e)].endswith("u"):
            new = w[: -len(e)]
    if new is None:
        e = _end(w, """en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
            aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais
            aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""", rv)
        new = w[: len(w) - len(e)]
        if e in ("en", "es", "éis", "emos") and new.endswith("gu"):
            new = new[:-1]
    w = new
    e = _end(w, "os a o á í ó e é", rv)
    w = w[: len(w) - len(e)]
    if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
        w = w[:-1]
    return w.translate(plain)


def portuguese(w: str) -> str:
    vowels = "aeiouáéíóúâêô"
    w = w.replace("ã", "a~").replace("õ", "o~")
    rv, (r1, r2) = _rv(w, vowels), _regions(w, vowels)

    def before(*more: str) -> Callable:
        return lambda s, e: s + e if len(s) < r2 else next((s[: -len(x)] for x in more if s.endswith(x) and len(s) - len(x) >= r2), s)

    def adverb(s: str, e: str) -> str:
        if len(s) < r1:
            return s + e
        if _end(s, "iv", r2):
            return _cut(s[:-2], "at", r2)
        return _cut(s, "os ic ad", r2)

    put = lambda new: lambda s, e: s + new if len(s) >= r2 else s + e
    new = _rules(w, [
        ("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", before()),
        ("logia logias", put("log")), ("uça~o uço~es", put("u")), ("ência ências", put("ente")), ("amente", adverb), ("mente", before("ante", "avel", "ível", "ável")),
        ("idade idades", before("abil", "ic", "iv")), ("iva ivo ivas ivos", before("at")), ("ira iras", lambda s, e: s + "ir" if len(s) >= rv and s.endswith("e") else s + e),
    ])
    if new is None:
        new = _cut(w, """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo
            ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis
            areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos
            eu iu ou ira iras""", rv)
    if new != w:
        w = new[:-1] if new.endswith("ci") and len(new) - 1 >= rv else new
    else:
        w = _cut(w, "os a i o á í ó", rv)
    if _end(w, "e é ê", rv):
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


def italian(w: str) -> str:
    vowels = "aeiouàèìòù"
    w = w.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = _upper_between(w, "ui", vowels)
    rv, (r1, r2) = _rv(w, vowels), _regions(w, vowels)
    e = _end(w, "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene", rv)
    if e:
        s = w[: -len(e)]
        if _end(s, "ando endo", rv):
            w = s
        elif _end(s, "ar er ir", rv):
            w = s + "e"

    def before(*more: str) -> Callable:
        return lambda s, e: s + e if len(s) < r2 else next((s[: -len(x)] for x in more if s.endswith(x) and len(s) - len(x) >= r2), s)

    def adverb(s: str, e: str) -> str:
        if len(s) < r1:
            return s + e
        if _end(s, "iv", r2):
            return _cut(s[:-2], "at", r2)
        return _cut(s, "os ic abil", r2)

    def tive(s: str, e: str) -> str:
        if len(s) < r2:
            return s + e
        return _cut(s[:-2], "ic", r2) if _end(s, "at", r2) else s

    put = lambda new: lambda s, e: s + new if len(s) >= r2 else s + e
    new = _rules(w, [
        ("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", before()), ("azione azioni atore atori", before("ic")),
        ("logia logie", put("log")), ("uzione uzioni usione usioni", put("u")), ("enza enze", put("ente")), ("amento amenti imento imenti", lambda s, e: s if len(s) >= rv else s + e),
        ("amente", adverb), ("ità", before("abil", "ic", "iv")), ("ivo ivi iva ive", tive),
    ])
    if new is None:
        new = _cut(w, """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò
            erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva
            ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir""", rv)
    w = new
    if _end(w, "a e i o à è ì ò", rv):
        w = w[:-1]
        w = w[:-1] if _end(w, "i", rv) else w
    if _end(w, "ch gh", rv):
        w = w[:-1]
    return w.lower()


def french(w: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    w = _upper_between(w.replace("qu", "qU"), "ui", vowels)
    w = re.sub(rf"(?<=[{vowels}])y|y(?=[{vowels}])", "Y", w)
    if w.startswith(("par", "col", "tap")) or (len(w) > 2 and w[0] in vowels and w[1] in vowels):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in vowels), len(w))
    r1, r2 = _regions(w, vowels)
    was = w

    def ic(s: str, e: str) -> str:
        if len(s) < r2:
            return s + e
        return (s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU") if s.endswith("ic") else s

    def ement(s: str, e: str) -> str:
        if len(s) < rv:
            return s + e
        if _end(s, "iv", r2):
            return _cut(s[:-2], "at", r2)
        if s.endswith("eus"):
            return s[:-3] if len(s) - 3 >= r2 else s[:-3] + "eux" if len(s) - 3 >= r1 else s
        if s.endswith(("abl", "iqU")):
            return s[:-3] if len(s) - 3 >= r2 else s
        return s[:-3] + "i" if s.endswith(("ièr", "Ièr")) and len(s) - 3 >= rv else s

    def ite(s: str, e: str) -> str:
        if len(s) < r2:
            return s + e
        if s.endswith("abil"):
            return s[:-4] if len(s) - 4 >= r2 else s[:-4] + "abl"
        if s.endswith("ic"):
            return s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU"
        return _cut(s, "iv", r2)

    def ive(s: str, e: str) -> str:
        if len(s) < r2:
            return s + e
        if not _end(s, "at", r2):
            return s
        s = s[:-2]
        return (s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU") if s.endswith("ic") else s

    put = lambda new, region: lambda s, e: s + new if len(s) >= region else s + e
    new = _rules(w, [
        ("ance iqUe isme able iste eux ances iqUes ismes ables istes", put("", r2)), ("atrice ateur ation atrices ateurs ations", ic), ("logie logies", put("log", r2)), ("usion ution usions utions", put("u", r2)),
        ("ence ences", put("ent", r2)), ("ement ements", ement), ("ité ités", ite), ("if ive ifs ives", ive), ("eaux", lambda s, e: s + "eau"), ("aux", put("al", r1)),
        ("euse euses", lambda s, e: s if len(s) >= r2 else s + "eux" if len(s) >= r1 else s + e), ("issement issements", lambda s, e: s if len(s) >= r1 and s[-1:] not in (*vowels, "") else s + e),
        ("amment", put("ant", rv)), ("emment", put("ent", rv)), ("ment ments", lambda s, e: s if s[-1:] and s[-1] in vowels and len(s) - 1 >= rv else s + e),
    ])
    adverb = new is not None and w.endswith(("amment", "emment", "ment", "ments")) and not w.endswith(("ement", "ements", "issement", "issements"))
    w = new or w
    if new is None or adverb:
        e = _end(w, "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it", rv)
        s = w[: len(w) - len(e)]
        if e and len(s) - 1 >= rv and s[-1] not in vowels:
            w = s
        else:
            e = _end(w, "ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions", rv)
            s = w[: len(w) - len(e)]
            if e == "ions":
                w = s if len(s) >= r2 else w
            elif e in ("âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse", "assent", "asses", "assiez", "assions"):
                w = s[:-1] if s.endswith("e") and len(s) - 1 >= rv else s
            else:
                w = s
    if w != was:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and w[-2:-1] not in (*"aiouès", ""):
            w = w[:-1]
        e = _end(w, "ion ier ière Ier Ière e ë", rv)
        s = w[: len(w) - len(e)]
        if e == "ion":
            w = s if len(s) >= r2 and s.endswith(("s", "t")) and len(s) - 1 >= rv else w
        elif e in ("ier", "ière", "Ier", "Ière"):
            w = s + "i"
        elif e == "e" or (e == "ë" and s.endswith("gu")):
            w = s
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    return re.sub(rf"[éè]([^{vowels}]+)$", r"e\1", w).lower()


# --- Russian ----------------------------------------------------------------------------------------------------------


def russian(w: str) -> str:
    vowels = "аеиоуыэюя"
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in vowels), len(w))
    _, r2 = _regions(w, vowels)

    def cut(x: str, after_a: str, free: str) -> str | None:
        """Without the longest ending: of the first kind, only after а or я, which stays."""
        e = _end(x, f"{after_a} {free}", rv)
        if not e:
            return None
        s = x[: -len(e)]
        if e in free.split():
            return s
        return s if len(s) - 1 >= rv and s[-1] in "ая" else cut(x, "", " ".join(f for f in free.split() if len(f) < len(e))) if free else None

    out = cut(w, "в вши вшись", "ив ивши ившись ыв ывши ывшись")
    if out is None:
        w = _cut(w, "ся сь", rv)
        e = _end(w, "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею", rv)
        if e:
            s = w[: -len(e)]
            out = cut(s, "ем нн вш ющ щ", "ивш ывш ующ")
            out = s if out is None else out
        else:
            out = cut(w, "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
            if out is None:
                out = _cut(w, "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я", rv)
    w = _cut(out, "и", rv)
    w = _cut(w, "ост ость", max(r2, rv))
    e = _end(w, "ейш ейше нн ь", rv)
    if e in ("ейш", "ейше"):
        w = w[: -len(e)]
        w = w[:-1] if _end(w, "нн", rv) else w
    elif e:
        w = w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {"da": danish, "nl": dutch, "fr": french, "de": german, "it": italian, "no": norwegian, "pt": portuguese, "ru": russian, "es": spanish, "sv": swedish}
