"""Surrogates in plain Python: what tallyfold.llm.pii says in SQL, text by text, with the regex and hmac modules."""

import hashlib
import hmac

import regex

from tallyfold.llm.pii import COMMON, COUNTRIES, ENDINGS, FEMALE, KINDS, MALE, NEUTRAL, PARTICLES, ROUNDS

TITLE = regex.compile("(?:" + "|".join((*FEMALE, *MALE, *NEUTRAL)) + r")\.?")
ASKED = regex.compile(r"\b(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?$")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def check_sum(digits):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(digits)))


def mod97(v):
    return int("".join(str(int(c, 36)) for c in v)) % 97


def gender(title):
    words = {w.rstrip(".") for w in title.split(" ")}
    return "f" if words & set(FEMALE) else "m" if words & set(MALE) else "n"


def kind_of(x, before):
    for k, p in KINDS.items():
        if k != "secret" and regex.fullmatch(p, x):
            sound = check_sum(regex.sub(r"\D", "", x)) % 10 == 0 if k == "card" else mod97((n := x.replace(" ", ""))[4:] + n[:4]) == 1 if k == "iban" else True
            return k if sound else "secret" if ASKED.search(before) else ""
    return "secret"


def canonical(k, x):
    digits = regex.sub(r"[^0-9]", "", x)
    return {"phone": digits[-10:], "card": digits, "ssn": digits, "iban": x.replace(" ", ""), "email": x.lower(), "ipv6": x.lower()}.get(k, x)


def stays(word):
    return word in PARTICLES or TITLE.fullmatch(word)


def one_case(word):
    return word[0] + word[1:].lower() if word == word.upper() else word


def parse(text):
    """[(piece, kind, units)]"""
    who = {}
    for m in regex.finditer(KINDS["name"], text):
        words, g = [w for w in m.group().split(" ") if not stays(w)], gender(m.group())
        for w in words:
            if who.get(w, "n") == "n":
                who[w] = g
    known = "|".join(r"(?<![.!?:;\n]\s)(?<![\n])(?<!\A)" + w if w in COMMON else w for w in who)
    pattern = "|".join(f"(?:{p})" for p in KINDS.values()) + (rf"|(?<![\p{{L}}\p{{N}}])(?:{known})(?: (?:{known})){{0,7}}(?!['’\-]?\p{{L}})" if who else "")
    out, last = [], 0
    for m in regex.finditer(pattern, text):
        x, before = m.group(), text[last : m.start()]
        out.append((before, "", []))
        words = x.split(" ")
        k = "name" if who and all(w in who for w in words) else kind_of(x, before)
        if k == "name":
            g = gender(x)
            units = ["" if stays(w) else ("name", (g if g != "n" else who.get(w, "n")) + ":" + one_case(w)) for w in words]
        else:
            units = [(k, canonical(k, x))] if k else []
        out.append((x, k, units))
        last = m.end()
    return [*out, (text[last:], "", [])]


def made(k, c, attempt, key):
    stream = b"".join(hmac.new(key, f"{n}|{k}|{attempt}|{c}".encode(), hashlib.sha512).digest() for n in range(4))
    at = lambda i: stream[i % 256]

    def drawn(v, keep=0, letters=LETTERS):
        out = ""
        for i, ch in enumerate(v):
            if i < keep or not (ch.isascii() and ch.isalnum()):
                out += ch
            elif ch.isdigit():
                out += str(at(i) % 10)
            else:
                d = letters[at(i) % len(letters)]
                out += d.upper() if ch.isupper() else d
        return out

    extra = lambda n: "".join(LETTERS[at(255 - j) % 26] for j in range(1, n + 1))
    if k == "email":
        head, tail = c.rsplit(".", 1)
        return extra(2 * attempt) + drawn(head + ".") + tail
    if k == "ip":
        return ".".join(
            str(
                at(2 * i) % 10 if not attempt and len(o) == 1 else 10 + at(2 * i) % 90 if not attempt and len(o) == 2 else 100 + (
                    256 * at(2 * i) + at(2 * i + 1)
                ) % 156
            ) for i,
            o in enumerate(c.split("."))
        )
    if k == "ipv6":
        return ":".join(
            "".join("0123456789abcdef"[at(4 * i + j) % 16] for j in range(1, (4 if attempt else len(o)) + 1)) if o else "" for i,
            o in enumerate(c.split(":"))
        )
    if k == "iban":
        assert c[:2] in COUNTRIES.split()
        body = drawn(c, 4)[4:]
        return f"{c[:2]}{98 - mod97(body + c[:2] + '00'):02d}{body}"
    if k == "card":
        body = drawn(c[:-1], 1)
        return body + str(-check_sum(body + "0") % 10)
    if k == "key":
        return drawn(c, 4)
    if k == "name":
        script = "cyrillic" if any("\u0400" <= ch <= "\u04ff" for ch in c) else "latin"
        consonants, vowels = {"latin": ("bdfgklmnprstvzhj", "aeio"), "cyrillic": ("бдфгклмнпрствзхж", "аеио")}[script]
        n = min(4, max(2, len(c) // 3)) + attempt
        return ("".join(consonants[at(j) % 64 // 4] + vowels[at(j) % 4] for j in range(1, n + 1)) + ENDINGS[script, c[0]]).capitalize()
    if k == "secret":
        return drawn(c, 0, "abcdef" if regex.fullmatch("[0-9a-f]+", c) else LETTERS) + extra(attempt)
    return drawn(c)


def laid_out(k, x, s):
    if k in ("phone", "card", "ssn", "iban"):
        places = [i for i, ch in enumerate(x) if ch.isalnum()][-len(s) :]
        out = list(x)
        for i, ch in zip(places, s):
            out[i] = ch
        return "".join(out)
    if k == "email":
        more = len(s) - len(x)
        return s[:more] + "".join(b.upper() if a.isupper() else b for a, b in zip(x, s[more:]))
    return s.upper() if k == "ipv6" and regex.search("[A-F]", x) else s


def pseudonymise(texts, key):
    """[(text, number of entities)]"""
    key = hashlib.sha512(b"surrogates\0" + key.encode()).digest()
    parsed = [None if t is None else parse(t) for t in texts]
    waiting = {u for p in parsed if p for _, _, us in p for u in us if u}
    taken = {(k, c[2:] if k == "name" else c) for k, c in waiting}
    final, attempt = {}, 0
    while waiting:
        assert attempt < ROUNDS
        now = {u: made(*u, attempt, key) for u in waiting}
        free = {}
        for u in sorted(waiting, key="|".join):
            if (u[0], now[u]) not in taken and (u[0], now[u]) not in free:
                free[u[0], now[u]] = u
        # of those that meet, only the least may keep a surrogate, and only if it is free
        final |= {u: s for (_, s), u in free.items()}
        taken |= {(k, s) for (k, _), s in now.items()}
        waiting, attempt = waiting - set(free.values()), attempt + 1
    out = []
    for p in parsed:
        if p is None:
            out.append((None, 0))
            continue
        text = ""
        for x, k, us in p:
            if k == "name":
                text += " ".join(w if not u else final[u].upper() if w == w.upper() else final[u] for w, u in zip(x.split(" "), us))
            else:
                text += laid_out(k, x, final[us[0]]) if k else x
        out.append((text, sum(1 for _, k, _ in p if k)))
    return out
