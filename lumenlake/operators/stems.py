"""German word stems by the published Snowball rules, and common German words that a search leaves out."""

from __future__ import annotations

# Words without a meaning of their own.
STOP = frozenset(
    "aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dich die dies diese dieser dieses dir doch dort du durch ein eine einem einen einer eines er es euch für hat hatte "
    "hier hin ich ihm ihn ihnen ihr ihre im in ist jede jeder jetzt kann kein keine können man mein mich mir mit muss nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so soll über um und uns unser unter "
    "vom von vor war waren warst was weil welche wenn werde werden wie wieder wir wird wo wollen während zu zum zur zwar zwischen".split()
)
_VOWELS = "aeiouyäöü"


def _region(word: str, at: int) -> int:
    """The place after the first consonant that follows a vowel, from a place on; the word's end where there is none."""
    for i in range(at + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def german(word: str) -> str:
    """The stem of a word in small letters. Capital U and Y mark those between vowels, which count as consonants."""
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in _VOWELS and w[i + 1] in _VOWELS else c for i, c in enumerate(w))
    one = _region(w, 0)
    two = _region(w, one)
    one = max(one, 3)  # the first region leaves three letters at least
    ends = lambda *x: max((e for e in x if w.endswith(e)), key=len, default=None)
    inside = lambda end, region: len(w) - len(end) >= region

    end = ends("em", "ern", "er", "e", "en", "es", "s")
    if end and inside(end, one):
        if end == "s":
            w = w[:-1] if w[-2:-1] and w[-2] in "bdfghklmnrt" else w
        else:
            w = w[: -len(end)]
            if end in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    end = ends("en", "er", "est", "st")
    if end and inside(end, one) and (end != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(end)]
    end = ends("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
    if end and inside(end, two):
        before = w[: -len(end)]
        if end in ("end", "ung"):
            w = before
            if w.endswith("ig") and inside("ig", two) and not w.endswith("eig"):
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            w = before if not before.endswith("e") else w
        elif end in ("lich", "heit"):
            w = before
            if w.endswith(("er", "en")) and inside("er", one):
                w = w[:-2]
        else:
            w = before
            end = ends("lich", "ig")
            if end and inside(end, two):
                w = w[: -len(end)]
    return w.lower().translate(str.maketrans("äöü", "aou"))
