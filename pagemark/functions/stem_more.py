"""German and Russian stems by the published Snowball algorithms."""

from __future__ import annotations

import re

# Fixed values of the published German algorithm.
_DE_VOWELS = "aeiouyäöü"
_DE_S, _DE_ST = "bdfghklmnrt", "bdfghklmnt"

# Fixed values of the published Russian algorithm; those of group 1 follow а or я.
_RU_VOWELS = "аеиоуыэюя"
_RU_GERUND_1 = ("в", "вши", "вшись")
_RU_GERUND_2 = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_RU_ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_RU_PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
_RU_PARTICIPLE_2 = ("ивш", "ывш", "ующ")
_RU_VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
_RU_VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
_RU_NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")


def _region(word: str, start: int, vowels: str) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem_de(word: str) -> str:
    w = re.sub(f"(?<=[{_DE_VOWELS}])([uy])(?=[{_DE_VOWELS}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    first = _region(w, 0, _DE_VOWELS)
    r2 = _region(w, first, _DE_VOWELS)
    r1 = max(first, 3)
    # Endings of cases and plurals.
    e = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and len(w) - len(e) >= r1 and (e != "s" or w[-2:-1] in tuple(_DE_S)):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    # Endings of comparison and of verbs.
    e = _ending(w, ("en", "er", "est", "st"))
    if e and len(w) - len(e) >= r1 and (e != "st" or len(w) >= 6 and w[-3] in _DE_ST):
        w = w[: -len(e)]
    # Endings that make words of others.
    e = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    at = len(w) - len(e) if e else 0
    if e and at >= r2 and not (e in ("ig", "ik", "isch") and w[at - 1 : at] == "e"):
        w = w[:at]
        if e in ("end", "ung") and w.endswith("ig") and at - 2 >= r2 and not w.endswith("eig"):
            w = w[:-2]
        elif e in ("lich", "heit") and w.endswith(("er", "en")) and at - 2 >= r1:
            w = w[:-2]
        elif e == "keit" and (more := _ending(w, ("lich", "ig"))) and at - len(more) >= r2:
            w = w[: -len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _ru_cut(w: str, rv: int, after: tuple[str, ...], free: tuple[str, ...]) -> str | None:
    """``w`` without its longest ending inside the region, or None; ``after`` needs а or я before."""
    e = _ending(w[rv:], after + free)
    if e is None:
        return None
    rest = w[: -len(e)]
    if e in free or rest[rv:].endswith(("а", "я")):
        return rest
    return None


def stem_ru(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RU_VOWELS}]", w)
    if not m:
        return w
    rv = m.end()
    r2 = _region(w, _region(w, 0, _RU_VOWELS), _RU_VOWELS)
    cut = _ru_cut(w, rv, _RU_GERUND_1, _RU_GERUND_2)
    if cut is not None:
        w = cut
    else:
        w = w[:-2] if w[rv:].endswith(("ся", "сь")) else w
        cut = _ru_cut(w, rv, (), _RU_ADJECTIVE)
        if cut is not None:
            w = cut
            less = _ru_cut(w, rv, _RU_PARTICIPLE_1, _RU_PARTICIPLE_2)
            w = w if less is None else less
        else:
            for after, free in ((_RU_VERB_1, _RU_VERB_2), ((), _RU_NOUN)):
                cut = _ru_cut(w, rv, after, free)
                if cut is not None:
                    w = cut
                    break
    if w[rv:].endswith("и"):
        w = w[:-1]
    e = _ending(w[max(r2, rv) :], ("ост", "ость"))
    if e:
        w = w[: -len(e)]
    if e := _ending(w[rv:], ("ейш", "ейше")):
        w = w[: -len(e)]
    if w[rv:].endswith("нн"):
        w = w[:-1]
    elif not e and w[rv:].endswith("ь"):
        w = w[:-1]
    return w
