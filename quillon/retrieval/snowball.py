"""Stop words and stemmers for French, German and Spanish, by the published Snowball rules.

A stemmer is a few steps over a word and the places where its regions begin
(R1 behind the first consonant after a vowel, R2 the same within R1, RV by a
rule of each language). A step looks for the longest of its endings; a table
says in which region the ending must lie and what takes its place. Terms
with a digit stay as they are.
"""

from __future__ import annotations

from functools import lru_cache


def _words(text: str) -> list[str]:
    return text.split()


def _paradigm(stems: str, endings: str) -> set[str]:
    """Every stem with every ending; ``-`` is no ending."""
    return {s + (e if e != "-" else "") for s in stems.split() for e in endings.split()}


# fixed values: stop words; those that are inflected come from their paradigms
_FRENCH_STOPS = frozenset(_words(
    """au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui
    sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y ceci cela celà cet cette ici ils les leurs quel quels quelle quelles sans soi
    été étée étées étés étant suis es êtes sont fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent
    ayant eu eue eues eus ai avons avez ont avais avait aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent
    étais était étions étiez étaient aurai aurons aurez auront aurais aurait aurions auriez auraient"""
)) | _paradigm("ser", "ai as a ons ez ont ais ait ions iez aient")
_GERMAN_STOPS = frozenset(_words(
    """aber als also am an anderm andern anderr auch auf aus bei bin bis bist da damit dann der den des dem die das daß derselbe derselben denselben
    desselben demselben dieselbe dieselben dasselbe dazu denn derer dessen dich dir du dies doch dort durch ein einig einmal er ihn ihm es etwas euer für
    gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr euch im in indem ins ist jetzt kann kein können könnte machen man mein
    mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein selbst sich sie ihnen sind so soll sollte sondern sonst über um und uns unter viel
    vom von vor während war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar
    zwischen dein"""
)) | _paradigm("all ander dein dies ein einig eur ihr jed jen kein manch mein sein solch uns welch", "e em en er es")
_SPANISH_STOPS = frozenset(_words(
    """de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me
    hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto
    esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os esos esas
    estoy estamos estando estad he has ha hemos habéis han haya hayas hayamos hayáis hayan habiendo soy eres es somos sois son siendo sido era eras éramos erais
    eran sea seas seamos seáis sean tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan teniendo tened fui fuiste fue fuimos fuisteis fueron"""
)) | _paradigm("mí tuy suy nuestr vuestr estad habid tenid", "o a os as") | _paradigm("est", "ás á áis án é és emos éis én aba abas ábamos abais aban") | _paradigm("estar habr ser tendr", "é ás á emos éis án ía ías íamos íais ían") | _paradigm("hab ten", "ía ías íamos íais ían") | _paradigm("estuv hub tuv", "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen") | _paradigm("fu", "era eras éramos erais eran ese eses ésemos eseis esen")


def _past(word: str, at: int, inside) -> int:
    """The place behind the first character from ``at`` on that is ``inside``."""
    return next((i + 1 for i in range(at, len(word)) if inside(word[i])), len(word))


def _regions(word: str, vowels: str) -> tuple[int, int]:
    vowel, other = (lambda c: c in vowels), (lambda c: c not in vowels)
    r1 = _past(word, _past(word, 0, vowel), other)
    return r1, _past(word, _past(word, r1, vowel), other)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _less(word: str, ending: str, put: str = "") -> str:
    return word[: len(word) - len(ending)] + put


def _within(word: str, ending: str, region: int) -> bool:
    return len(word) - len(ending) >= region


def _trim(word: str, region: int, *endings: str) -> str:
    """Without the first of the endings that lies in the region."""
    for e in endings:
        if word.endswith(e):
            return _less(word, e) if _within(word, e, region) else word
    return word


# German

_DE = "aeiouyäöü"
_DE_FIRST = {e: "cut" for e in _words("erinnen erin ern em er en es e")} | {"s": "s", "ln": "l", "lns": "l"}
_DE_SECOND = _words("est en er st et")
_DE_THIRD = _words("keit lich heit isch end ung ig ik")


def _german_spelling(word: str) -> str:
    """u and y between vowels are consonants; ß is ss; ae, oe and ue are umlauts (but not after q)."""
    chars = list(word)
    for i in range(1, len(chars) - 1):
        if chars[i] in "uy" and chars[i - 1] in _DE and chars[i + 1] in _DE:
            chars[i] = chars[i].upper()
    out, i = [], 0
    while i < len(chars):
        pair = "".join(chars[i : i + 2])
        if pair == "qu":
            out.append(pair)
        elif pair in ("ae", "oe", "ue"):
            out.append({"a": "ä", "o": "ö", "u": "ü"}[pair[0]])
        else:
            out.append("ss" if chars[i] == "ß" else chars[i])
            i -= 1
        i += 2
    return "".join(out)


def _german(word: str) -> str:
    w = _german_spelling(word)
    r1, r2 = _regions(w, _DE)
    r1 = min(max(r1, 3), len(w))
    e = _ending(w, _DE_FIRST)
    if e and _within(w, e, r1) and not (e == "em" and w.endswith("system")):
        what = _DE_FIRST[e]
        if what == "s":
            w = _less(w, e) if len(w) > 1 and w[-2] in "bdfghklmnrt" else w
        else:
            w = _less(w, e, "" if what == "cut" else what)
            w = w[:-1] if e in ("e", "en", "es") and w.endswith("niss") else w
    e = _ending(w, _DE_SECOND)
    if e and _within(w, e, r1):
        before = _less(w, e)
        if e == "st":
            w = before if len(before) >= 4 and before[-1] in "bdfghklmnt" else w
        elif e == "et":
            w = before if before[-1:] in tuple("dfgklmnrstUzä") and not before.endswith(("geordn", "intern", "plan", "tick", "tr")) else w
        else:
            w = before
    e = _ending(w, _DE_THIRD)
    if e and _within(w, e, r2):
        before = _less(w, e)
        if e in ("end", "ung"):
            w = _trim(before, r2, "ig") if not before.endswith("eig") else before
        elif e in ("ig", "ik", "isch"):
            w = w if before.endswith("e") else before
        elif e == "keit":
            w = _trim(before, r2, "lich", "ig")
        else:
            w = _trim(before, r1, "er", "en")
    for e in ("'sch", "'s", "'"):
        if w.endswith(e):
            w = _less(w, e) if len(w) - len(e) >= 2 else w
            break
    return w.translate(str.maketrans("YUäöü", "yuaou"))


# Spanish

_ES = "aeiouáéíóúü"
_ES_PRONOUNS = _words("selas selos sela selo las les los nos la le lo me se")
_ES_BEFORE = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"} | {e: e for e in _words("yendo ando iendo ar er ir")}
#: ending: (region, what takes its place, endings that may go then)
_ES_SUFFIXES = (
    {e: ("r2", "", ()) for e in _words("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")}
    | {e: ("r2", "", ("ic",)) for e in _words("adora ador ación adoras adores aciones ante antes ancia ancias acion")}
    | {e: ("r2", "log", ()) for e in _words("logía logías")}
    | {e: ("r2", "u", ()) for e in _words("ución uciones ucion")}
    | {e: ("r2", "ente", ()) for e in _words("encia encias")}
    | {"amente": ("r1", "", ("iv", "os", "ic", "ad")), "mente": ("r2", "", ("ante", "able", "ible"))}
    | {e: ("r2", "", ("abil", "ic", "iv")) for e in _words("idad idades")}
    | {e: ("r2", "", ("at",)) for e in _words("iva ivo ivas ivos")}
)
_ES_Y = _words("yeron yendo yamos yais yan yen yas yes ya ye yo yó")
_ES_VERBS = _words(
    """aríamos eríamos iríamos iésemos iéramos ásemos áramos aríais eríais iríais asteis isteis arais ierais aseis ieseis ábamos íamos arían arías erían
    erías irían irías arán arás erán erás irán irás aría eréis aréis iréis ería iría aremos eremos iremos aban ían aran ieran asen iesen aron ieron ando iendo
    adas idas abas ías aras ieras ases ieses abais íais ados idos amos imos ará aré erá eré irá iré aba ada ida ía ara iera ase iese aste iste ado ido ió áis
    éis ad ed id an ar er ir as ís en es emos"""
)


def _spanish_rv(word: str) -> int:
    if len(word) < 2:
        return len(word)
    first, second = word[0] in _ES, word[1] in _ES
    if not second:
        return _past(word, 2, lambda c: c in _ES)
    if first:
        return _past(word, 2, lambda c: c not in _ES)
    return min(3, len(word)) if len(word) >= 3 else len(word)


def _after_gu(word: str, region: int = 0) -> str:
    """A u that only kept a g hard goes with its vowel."""
    return word[:-1] if word.endswith("gu") and _within(word, "u", region) else word


def _spanish(word: str) -> str:
    w = word
    (r1, r2), rv = _regions(w, _ES), _spanish_rv(w)
    places = {"r1": r1, "r2": r2}
    if pronoun := _ending(w, _ES_PRONOUNS):
        verb = _less(w, pronoun)
        e = _ending(verb, _ES_BEFORE)
        if e and _within(verb, e, rv) and (e != "yendo" or verb.endswith("uyendo")):
            w = _less(verb, e, _ES_BEFORE[e])
    e, done = _ending(w, _ES_SUFFIXES), False
    if e:
        region, put, more = _ES_SUFFIXES[e]
        if _within(w, e, places[region]):
            w, done = _less(w, e, put), True
            then = next((x for x in more if w.endswith(x) and _within(w, x, r2)), "")
            w = _less(w, then)
            if e == "amente" and then == "iv":
                w = _trim(w, r2, "at")
    if not done:
        e = _ending(w, _ES_Y)
        if e and _within(w, e, rv) and _less(w, e).endswith("u"):
            w = _less(w, e)
        else:
            e = _ending(w, _ES_VERBS)
            if e and _within(w, e, rv):
                w = _less(w, e)
                w = _after_gu(w) if e in ("en", "es", "éis", "emos") else w
    e = _ending(w, _words("os a o á í ó e é"))
    if e and _within(w, e, rv):
        w = _less(w, e)
        w = _after_gu(w, rv) if e in "eé" else w
    return w.translate(str.maketrans("áéíóú", "aeiou"))


# French

_FR = "aeiouyâàëéêèïîôûù"
_FR_TABLE = {
    **{e: ("r2", "") for e in _words("ance iqUe isme able iste eux ances iqUes ismes ables istes")},
    **{e: ("r2", "") for e in _words("atrice ateur ation atrices ateurs ations ité ités if ive ifs ives")},
    **{e: ("r2", "log") for e in _words("logie logies")},
    **{e: ("r2", "u") for e in _words("usion ution usions utions")},
    **{e: ("r2", "ent") for e in _words("ence ences")},
    **{e: ("rv", "") for e in _words("ement ements")},
    **{e: ("r1", "") for e in _words("issement issements")},
    "eaux": ("", "eau"), "aux": ("r1", "al"), "oux": ("", "ou"), "euse": ("r2", ""), "euses": ("r2", ""), "amment": ("rv", "ant"), "emment": ("rv", "ent"), "ment": ("", ""), "ments": ("", ""),
}
_FR_I_VERBS = _words("issaIent issante issantes issants issions issiez issons issez issent isses isse issais issait issant iraIent irions iriez irons iront irez irais irait iras irent irai ira îmes îtes ies ie ir is it i ît")
_FR_CUT = _words("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_FR_CUT_E = _words("âmes ât âtes a ai aIent ait ant ante antes ants as asse assent asses assiez assions")
_FR_VERBS = [*_FR_CUT, *_FR_CUT_E, "ions", "ais", "aise", "aises", "eais"]


def elided(term: str) -> str:
    """A French term without an elided article or pronoun before it."""
    head, mark, rest = term.partition("'")
    return rest if mark and rest and head in ("c", "d", "j", "l", "m", "n", "s", "t", "z", "qu") and len(term) > 2 else term


def _french_spelling(word: str) -> str:
    """Vowels that count as consonants in capitals; ë and ï behind an H."""
    chars: list[str] = []
    rest = list(word)
    for i, c in enumerate(rest):
        if c in "ëï":
            chars += ["H", "e" if c == "ë" else "i"]
            continue
        before, after = bool(chars) and chars[-1] in _FR, i + 1 < len(rest) and rest[i + 1] in _FR
        if (c in "ui" and before and after) or (c == "u" and chars[-1:] == ["q"]) or (c == "y" and (before or after)):
            c = c.upper()
        chars.append(c)
    return "".join(chars)


def _french_rv(word: str) -> int:
    if len(word) >= 3 and (word[0] in _FR and word[1] in _FR or word.startswith(("par", "col", "tap")) or (word.startswith("ni") and word[2] in _FR)):
        return 3
    return _past(word, 1, lambda c: c in _FR) if len(word) > 1 else len(word)


def _ic(word: str, r2: int) -> str:
    """What is left before -ation and -ité: ic goes, or is written iqU."""
    return (_less(word, "ic") if _within(word, "ic", r2) else _less(word, "ic", "iqU")) if word.endswith("ic") else word


def _french_suffix(w: str, r1: int, r2: int, rv: int) -> tuple[str, bool, bool]:
    """The word, whether a suffix went, and whether verb endings are looked for nevertheless."""
    e = _ending(w, _FR_TABLE)
    if not e:
        return w, False, False
    region, put = _FR_TABLE[e]
    before = _less(w, e)
    if e in ("ment", "ments"):
        ok = before[-1:] and before[-1] in _FR and len(before) - 1 >= rv
        return (before, True, True) if ok else (w, False, False)
    if e == "oux" and before[-1:] not in tuple("bhjlnp"):
        return w, False, False
    if e in ("euse", "euses") and not _within(w, e, r2):
        return (before + "eux", True, False) if _within(w, e, r1) else (w, False, False)
    if region and not _within(w, e, {"r1": r1, "r2": r2, "rv": rv}[region]):
        return w, False, False
    if e.startswith("issement") and (not before or before[-1] in _FR):
        return w, False, False
    w = before + put
    if e.startswith(("atrice", "ateur", "ation")):
        w = _ic(w, r2)
    elif e.startswith("ité"):
        if w.endswith("abil"):
            w = _less(w, "abil") if _within(w, "abil", r2) else _less(w, "abil", "abl")
        else:
            w = _ic(w, r2) if w.endswith("ic") else _trim(w, r2, "iv")
    elif e in ("if", "ive", "ifs", "ives"):
        if w.endswith("at") and _within(w, "at", r2):
            w = _ic(_less(w, "at"), r2)
    elif e.startswith("ement"):
        if w.endswith("iv") and _within(w, "iv", r2):
            w = _trim(_less(w, "iv"), r2, "at")
        elif w.endswith("eus"):
            w = _less(w, "eus") if _within(w, "eus", r2) else _less(w, "eus", "eux") if _within(w, "eus", r1) else w
        elif w.endswith(("abl", "iqU")):
            w = _trim(w, r2, "abl", "iqU")
        elif w.endswith(("ièr", "Ièr")) and _within(w, "ièr", rv):
            w = _less(w, "ièr", "i")
    return w, True, e in ("amment", "emment")


def _french_verb(w: str, r2: int, rv: int) -> str:
    e = _ending(w, _FR_I_VERBS)
    if e and _within(w, e, rv):
        before = _less(w, e)
        if len(before) - 1 >= rv and before[-1] not in _FR + "H":
            return before
    e = _ending(w, _FR_VERBS)
    if not e or not _within(w, e, rv):
        return w
    before = _less(w, e)
    if e == "ions":
        return before if _within(w, e, r2) else w
    if e in _FR_CUT_E:
        return _trim(before, rv, "e")
    if e in ("ais", "aise", "aises") and (before.endswith(("auv", "épl")) or (before.endswith("al") and len(before) == 3)):
        return w
    return before


def _french(word: str) -> str:
    start = w = _french_spelling(elided(word))
    (r1, r2), rv = _regions(w, _FR), _french_rv(w)
    w, cut, more = _french_suffix(w, r1, r2, rv)
    if not cut or more:
        w = _french_verb(w, r2, rv)
    if w != start:
        w = w[:-1] + {"Y": "i", "ç": "c"}[w[-1]] if w[-1:] in ("Y", "ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and (w.endswith("His") or w[-2] not in "aiouès"):
            w = w[:-1]
        e = _ending(w, ("ière", "Ière", "ier", "Ier", "ion", "e"))
        if e and _within(w, e, rv):
            if e == "ion":
                w = _less(w, e) if _within(w, e, r2) and _less(w, e)[-1:] in ("s", "t") else w
            else:
                w = _less(w, e, "" if e == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    at = next((i for i in range(len(w) - 1, -1, -1) if w[i] in _FR), -1)
    if 0 <= at < len(w) - 1 and w[at] in "éè":
        w = w[:at] + "e" + w[at + 1 :]
    return w.replace("He", "ë").replace("Hi", "ï").replace("H", "").translate(str.maketrans("IUY", "iuy"))


_STEMMERS = {"french": _french, "german": _german, "spanish": _spanish}
STOPS = {"french": _FRENCH_STOPS, "german": _GERMAN_STOPS, "spanish": _SPANISH_STOPS}


@lru_cache(maxsize=200_000)
def stem(word: str, language: str) -> str:
    if any("0" <= c <= "9" for c in word):
        return word
    return _STEMMERS[language](word) or word
