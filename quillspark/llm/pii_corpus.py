"""Generated texts with labelled personal data, for training and testing the random field."""

from __future__ import annotations

import random

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "NATIONAL_ID", "IBAN", "PERSON", "SECRET")
#: Common first names of English, German, French and Spanish, which introduce a name where words with capitals follow.
FIRST_NAMES = (
    "james john robert michael william david richard joseph thomas christopher charles daniel matthew anthony donald steven paul andrew joshua kenneth kevin brian george timothy ronald jason edward jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon "
    "benjamin samuel gregory alexander patrick jack peter henry oliver simon martin philip mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie "
    "rebecca sharon laura cynthia kathleen amy angela shirley anna brenda pamela emma nicole helen samantha katherine christine rachel carolyn janet maria heather diane julie joyce victoria kelly christina joan evelyn olivia sophie charlotte "
    "hans klaus jürgen wolfgang werner dieter günter gerhard helmut manfred stefan andreas jens uwe matthias sven markus florian tobias lukas felix maximilian ursula monika petra sabine renate helga karin brigitte ingrid heike gabriele susanne birgit claudia katrin anja silke hannah lena "
    "jean pierre michel jacques philippe françois laurent nicolas julien antoine christophe olivier sébastien guillaume marie nathalie isabelle sylvie catherine françoise valérie sandrine céline aurélie camille chloé élodie mathilde "
    "josé juan carlos luis javier miguel ángel pedro fernando jorge alberto sergio diego raúl rafael pablo enrique carmen josefa isabel dolores cristina pilar elena lucía marta teresa raquel beatriz rocío mercedes inés gloria"
).split()

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é è ü ö ñ qu eau ch ß ment ción ung heit ll za".split()
_SHORT = "the of and to in is that it for der die und le la les de des el los y con on by".split()


def _word(r: random.Random) -> str:
    return r.choice(_SHORT) if r.random() < 0.4 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _short_word(r: random.Random) -> str:
    return r.choice(_SHORT) if r.random() < 0.4 else _word(r)[:8]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _name(r: random.Random) -> str:
    form = r.random()
    if form < 0.15:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)).capitalize()
    name = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 3))).capitalize()
    if form < 0.21:
        return r.choice(["O", "D", "N"]) + r.choice("''’") + name
    return f"{name}-{r.choice(_SYLLABLES).capitalize()}" if form < 0.25 else name


def _full_name(r: random.Random) -> str:
    """A first name of the list, with one or two others or alone."""
    first = r.choice(FIRST_NAMES).capitalize()
    return first + "".join(" " + (r.choice(FIRST_NAMES).capitalize() if r.random() < 0.15 else _name(r)) for _ in range(r.choice([0, 1, 1, 1, 2])))


def _plain(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))


def _email(r: random.Random) -> str:
    local = r.choice([f"{_word(r)}.{_digits(r, 2)}", _plain(r), f"{_plain(r)}.{_plain(r)}", f"{_plain(r)}.{_digits(r, 2)}", f"{_plain(r)}_{_digits(r, r.randint(1, 3))}", f"{_plain(r)}{_digits(r, 2)}", f"{_plain(r)}+{_plain(r)}", _word(r), f"{r.choice(_SHORT)}.{_digits(r, 2)}", f"{_word(r)}.{_digits(r, 2)}"])
    host = r.choice([_plain(r), f"mail{_digits(r, 1)}.{_plain(r)}", f"{_plain(r)}-{_plain(r)}", f"{_plain(r)}{_digits(r, 1)}.example", f"mail{_digits(r, 1)}.example"])
    return f"{local}@{host}.{r.choice(['com', 'org', 'net', 'co.uk', 'de', 'fr', 'io'])}"


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(2, 9)}{d(1)} {d(2)} {d(4)} {d(4)}", f"+{r.randint(2, 9)}{d(1)} {d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1{d(10)}", f"+1-{d(3)}-{d(3)}-{d(4)}"])


def _card(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([d(16), d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15), f"{d(4)} {d(6)} {d(5)}"])


def _iban(r: random.Random) -> str:
    head = r.choice(["DE", "FR", "ES", "GB"]) + _digits(r, 2)
    return r.choice([head + _digits(r, 18), head + "".join(f" {_digits(r, 4)}" for _ in range(4)) + " " + _digits(r, 2)])


def _secret(r: random.Random) -> tuple[str, str, str]:
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 40, 64])))
    mixed = "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(36))
    return r.choice([('token = "', hexa, '"'), ('token = "', hexa, '"'), ('api_key: "', mixed, '"'), ("secret=", hexa, ""), ("", "ghp_" + mixed, ""), ("", "AKIA" + mixed[:16].upper(), ""), ("", hexa, "")])


def _letters(r: random.Random) -> tuple[str, str, str]:
    """A secret without digits, and what stands around it."""
    made = r.choice([lambda: "".join(_plain(r) for _ in range(4))[: r.randint(9, 28)], lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(9, 40)))])()
    quote = r.choice(['"', "'", "", ""])
    word = r.choice(["password", "password", "Password", "PASSWORD", "secret", "token", "api_key", "API_TOKEN", "secret_key", "SECRET"])
    if r.random() < 0.25:  # in prose, with a digit or two
        at = r.randint(1, 8)
        return r.choice(["password", "Password", "secret", "token", "key", "passwd"]) + r.choice([" is ", " is ", " was ", " "]), made[:at] + _digits(r, r.randint(1, 3)) + made[at : at + r.randint(3, 9)], ""
    return word + r.choice([" = ", "=", ": ", ":", " : "]) + quote, made.ljust(9, "x"), quote


def _entity(r: random.Random) -> tuple[str, str, str, int]:
    """(before, entity, after, label)."""
    k = r.choice([1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 7, 7, 8, 8])
    if k == 8:
        return *(_letters(r) if r.random() < 0.5 else _secret(r)), k
    if k == 7 and r.random() < 0.4:
        return "", _full_name(r), "", k
    if k == 5 and r.random() < 0.4:
        letter = r.choice(["", r.choice("ABCDEFGHJKLMNPRSTXYZ")])
        return r.choice(["passport", "Passport", "passport no", "passport no.", "passport number", "Passport No", "id no", "licence no", "licence number", "license number"]) + r.choice([" ", ": "]), letter + _digits(r, r.choice([7, 8] if letter else [8, 9])), "", k
    if k == 7:
        cue = r.choice(["Mr. ", "Mr ", "Mrs. ", "Ms ", "Dr. ", "Prof. ", "Dear ", "Herr ", "Frau ", "Señor ", "Monsieur ", "Madame ", "my name is ", "My name is ", "Name: "])
        return cue, _name(r) + (" " + _name(r) if r.random() < 0.5 else ""), "", k
    made = {1: _email, 2: _phone, 3: lambda r: ".".join(str(r.randint(0, r.choice([9, 99, 254, 254]))) for _ in range(4)), 4: _card, 5: lambda r: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", 6: _iban}[k](r)
    if k == 1 and r.random() < 0.15:
        made = made.upper()
    return r.choice(["", "", "", "", {1: "mail ", 2: "call ", 3: "ip ", 4: "card ", 5: "ssn ", 6: "iban "}[k]]), made, "", k


def _harmless(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    if r.random() < 0.12:
        word = r.choice(["key", "keys", "secret", "password", "token", "tokens", "api", "Token", "Secret"])
        return r.choice([f"the {word} {_word(r)}", f"{word} {_word(r)} {_word(r)}", f"{word}: {_short_word(r)} {_word(r)}", f"{word}, {_word(r)}", f"{word} is {_word(r)}", f'key = "{_short_word(r)}"', f"the {_word(r)} {word}"])
    if r.random() < 0.3:
        caps = " ".join(_name(r) for _ in range(r.randint(1, 4)))
        return r.choice([f"the {caps}, Version {r.randint(1, 9)}.{r.randint(0, 9)}", f"under the {caps} {caps}, version {r.randint(1, 9)}", f"{caps} {r.randint(1, 99)}", f"from {_name(r).upper()} {_name(r).upper()[:2]}-{_name(r)[:2].upper()} {r.randint(1, 9)}.0", caps])
    return r.choice(
        [str(r.randint(1900, 2030)), str(r.randint(0, 99)), str(r.randint(100, 99999)), f"{r.randint(0, 99)}.{d(2)}", f"version {r.randint(1, 9)}", f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
         f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)}", f"{r.randint(0, 23)}:{d(2)}", f"{r.randint(1, 99)}%", f"{r.randint(1, 99)},000", f"#{d(5)}", f"item{d(2)}", f"@{_plain(r)}", f"{r.randint(1, 9)} @ {r.randint(1, 9)}",
         f"({r.randint(1, 20)})", f"{d(2)}-{d(2)}", f"{r.randint(1, 9)}st", f"{_plain(r)}{d(3)}", f"${d(3)}.{d(2)}", f"{d(6)}", f"{d(1)}x{d(2)}", f"{_plain(r)}-{d(2)}"]
    )


def _junk(r: random.Random) -> str:
    """A text without personal data in an odd form: one word or line over and over, capitals throughout, marks after each word, cells."""
    words = [_word(r) if r.random() < 0.5 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 60))]
    mark = r.choice(["", "", "!!", "&&&", "###", "%%%", "$$$", "***", " |", ","])
    form = r.random()
    if form < 0.25:
        return " ".join([r.choice([str.capitalize, str.upper, str.lower])(words[0])] * r.randint(3, 90))
    if form < 0.4:
        return "\n".join([" ".join(words[:8]).capitalize() + r.choice([".", ""])] * r.randint(2, 9))
    if form < 0.75:
        return " ".join(w.upper() + mark * (r.random() < 0.9) for w in words)
    return " ".join((w.capitalize() if r.random() < 0.3 else w) + r.choice(["", "."]) * (r.random() < 0.2) + mark for w in words)


def corpus(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """n texts and their labelled spans (start, end, label)."""
    r = random.Random(seed)
    texts, spans = [], []
    for _ in range(n):
        if r.random() < 0.15:
            texts.append(_junk(r))
            spans.append([])
            continue
        text, found, known = "", [], []
        noise = r.choice([None, None, None, ["&&&", "###", "%%%", "$$$", "***"], ["!!"], [" |"], [","]])
        start, upper = True, r.random() < 0.12

        def put(w: str) -> None:
            nonlocal text, start
            if start and w:
                w = w[0].upper() + w[1:]
            elif r.random() < 0.06:
                w = w.capitalize()
            text += w.upper() if upper else w
            if noise and r.random() < 0.6:
                text += r.choice(noise)
            start = False
            if r.random() < 0.12:
                text += "."
                start = True
            elif r.random() < 0.06:
                text += ","
            text += r.choice(["\n", " "]) if start and r.random() < 0.4 else " "

        for _ in range(r.randint(2, 6)):
            for _ in range(0 if r.random() < 0.12 else r.randint(1, 12)):
                put(_word(r))
            what = r.random()
            if what < 0.35:
                names = [x for _, made, _, k in known if k == 7 for x in made.split()]
                put(r.choice(names).lower() if names and r.random() < 0.1 else _harmless(r))
                continue
            if known and what < 0.6:
                before, made, after, k = r.choice(known)
                before, after = (before, after) if k == 8 or k == 5 and "-" not in made else ("", "")
                if k == 7:
                    made = r.choice(made.split()) if r.random() < 0.5 else made
                    made = made.upper() if r.random() < 0.15 else made
            else:
                before, made, after, k = _entity(r)
                known.append((before, made, after, k))
            if upper:
                before, made, after = before.upper() if k != 7 else before, made.upper(), after
            text += before
            if not (k == 7 and start and not before and " " not in made):  # one word with a capital at the start of a sentence says nothing
                found.append((len(text), len(text) + len(made), k))
            start = False
            text += made + after
            put("")
        for _ in range(r.randint(0, 8)):
            put(_word(r))
        texts.append(text)
        spans.append(found)
    return texts, spans
