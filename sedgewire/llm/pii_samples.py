"""Made-up texts with known personal data and with what looks like it, from which the span model learns. Everything follows from the seed."""

from __future__ import annotations

import random

_SYLLABLES = "an ba co de el fi ga ho in ka lo mi no or pe qu ra sa ti un ve wi xa yo zu th er on st".split()
_NAMES = "anna ben carla david eva frank gita hugo ines jonas kim lena marco nina oskar paula quentin rosa sven tara uwe vera wim yusuf zoe".split()
_ENDS = "com com com net org de fr es it nl eu io co.uk info edu".split()
# Words that people put beside what the kinds stand for, in four languages, and beside numbers that aren't personal.
_CUES = {
    "email": "email e-mail mail contact write reach kontakt schreib correo escribe courriel adresse".split(),
    "ip": "ip address host server client login from adresse servidor serveur".split(),
    "card": "card visa mastercard amex credit payment karte kreditkarte tarjeta carte paiement number".split(),
    "phone": "phone tel call mobile fax telefon anrufen handy ruf telefono llame movil telephone appelez cell whatsapp".split(),
}
_OTHER = "order invoice isbn version chapter page table figure date total price model serial ticket part nr ref id code section batch build release rechnung bestellung seite factura pedido pagina commande facture".split()


def luhn_digit(digits: str) -> str:
    """The digit that makes the number pass Luhn's test."""
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [self.word() + (r.choice([",", ".", ";"]) if r.random() < 0.12 else "") for _ in range(r.randint(low, high))]
        for k in range(len(out)):
            if r.random() < 0.03:
                out[k] = r.choice(["at", "dot", "a", "point", "punkt", "and", "or"])
        return " ".join(out)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def cut(self, digits: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(digits[at : at + n])
            at += n
        return sep.join([*out, *([digits[at:]] if at < len(digits) else [])])

    def email(self) -> str:
        r = self.r
        local = r.choice(_NAMES) + r.choice(["", ".", "_", "-"]) + r.choice([self.word(), self.digits(2), r.choice(_NAMES)])
        names = [self.word() + r.choice(["", "", self.word(), self.digits(1)]), *([self.word()] if r.random() < 0.2 else []), *r.choice(_ENDS).split(".")]
        x = r.random()
        if x < 0.3:
            at, dot = r.choice(["[at]", "(at)", "{at}", "[AT]", "(AT)", "<at>", "[@]", "(@)"]), r.choice(["[dot]", "(dot)", "{dot}", "[DOT]", ".", ".", "(.)", "[.]"])
            gap = r.choice(["", " "])
            dot = dot if dot == "." else gap + dot + gap
            return local.replace(".", dot if dot != "." and r.random() < 0.3 else ".") + gap + at + gap + dot.join(names)
        if x < 0.6:
            at, dot = r.choice([(" at ", " dot "), (" AT ", " DOT "), (" at ", " dot "), (" arroba ", " punto "), (" at ", " punkt "), ("_at_", "_dot_"), (" @ ", " dot "), ("-at-", "-dot-"), (" arobase ", " point ")])
            return local + at + dot.join(names)
        if x < 0.75:
            return local + r.choice([" @ ", " @", "@ "]) + r.choice([".", " . "]).join(names)
        if x < 0.85:
            return local + "＠" + ".".join(names)
        accents = lambda s: s.replace("o", "ö", 1).replace("a", "á", 1).replace("e", "é", 1)
        return r.choice([accents(local) + "@" + ".".join(names), accents(local) + "é@" + ".".join(names), local + "@" + accents(self.word() + "o") + "." + names[-1]])

    def ip(self) -> str:
        r = self.r
        four = [str(r.choice([10, 192, 172, r.randint(1, 255)])), *(str(r.randint(0, 255)) for _ in range(3))]
        x = r.random()
        if x < 0.5:
            return r.choice(["[.]", "(.)", "[dot]", " . ", "(dot)", " dot ", " [.] ", "{.}"]).join(four)
        group = lambda: f"{r.randint(0, 65535):x}"
        if x < 0.7:
            six = ":".join(group() for _ in range(8))
        else:
            n = r.randint(1, 4)
            six = ":".join(["2001", "db8", *(group() for _ in range(n))][-n - 1 :]) + "::" + ":".join(group() for _ in range(r.randint(0, 3)))
            six = r.choice([six, six, "fe80::" + ":".join(group() for _ in range(4))])
        return six.upper() if r.random() < 0.3 else six

    def card(self) -> str:
        r = self.r
        kind = r.choice(["amex", "amex", "diners", "long", "long", "long"])
        if kind == "amex":
            d = r.choice(["34", "37"]) + self.digits(12)
            d += luhn_digit(d)
            return self.cut(d, [4, 6, 5], r.choice([" ", "-", ".", ""]))
        if kind == "diners":
            d = r.choice(["36", "38", "300", "305"])
            d += self.digits(13 - len(d))
            d += luhn_digit(d)
            return self.cut(d, [4, 6, 4], r.choice([" ", "-", ""]))
        d = r.choice(["4", "51", "52", "55", "6011", "65"])
        d += self.digits(15 - len(d))
        d += luhn_digit(d)
        return self.cut(d, [4, 4, 4, 4], r.choice([".", "/", "_", "  ", " - ", " "]))

    def phone(self) -> str:
        r = self.r
        a, b, c = r.choice("23456789") + self.digits(2), r.choice("23456789") + self.digits(2), self.digits(4)
        x = r.random()
        if x < 0.45:
            return r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}"])
        if x < 0.7:
            country = r.choice(["44", "49", "33", "34", "39", "31"])
            return f"00{country}" + r.choice([" ", "-", ""]) + self.cut(r.choice("123456789") + self.digits(8), r.choice([[3, 3, 3], [2, 7], [1, 2, 2, 2, 2]]), r.choice([" ", "-"]))
        return r.choice([self.cut("0" + r.choice("1234567") + self.digits(8), [2, 2, 2, 2, 2], r.choice([" ", ".", "-"])), f"0{self.digits(2)}/{self.digits(7)}", f"0{self.digits(3)} {self.digits(7)}", f"0{self.digits(4)} {self.digits(6)}", f"0{self.digits(3)}-{self.digits(6)}"])

    def other(self) -> str:
        """What looks alike and isn't personal data."""
        r = self.r
        y, m, d = r.randint(1900, 2035), r.randint(1, 12), r.randint(1, 28)
        return r.choice(
            [
                lambda: f"{y}-{m:02}-{d:02}", lambda: f"{d:02}.{m:02}.{y}", lambda: f"{m}/{d}/{y}", lambda: f"{y}-{m:02}-{d:02} {d:02}:{m:02}:{d:02}", lambda: f"{y}-{y + r.randint(1, 40)}",
                lambda: f"{d:02}:{m:02}:{r.randint(0, 59):02}", lambda: ":".join(f"{r.randint(0, 255):02x}" for _ in range(6)), lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
                lambda: f"978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}", lambda: self.digits(r.randint(7, 19)), lambda: self.digits(16), lambda: self.digits(r.choice([16, 16, 15, 14])), lambda: f"#{self.digits(r.randint(5, 12))}",
                lambda: f"{r.randint(1, 999)},{self.digits(3)}.{self.digits(2)}", lambda: f"${r.randint(1, 99)}.{self.digits(2)}", lambda: " ".join(self.digits(r.randint(1, 4)) for _ in range(r.randint(3, 9))), lambda: self.cut(self.digits(16), [4, 4, 4, 4], r.choice([" ", "-", "."])),
                lambda: f"{self.word().upper()}-{self.digits(4)}-{self.digits(4)}", lambda: f"{self.digits(2)}.{self.digits(6)}, -{self.digits(2)}.{self.digits(6)}", lambda: "@" + self.word(), lambda: f"{self.word()} at {self.word()}.{self.word().capitalize()}", lambda: f"{self.word()} at {self.word()}. {self.word().capitalize()}",
                lambda: f"{self.word()} at {self.word()}.{r.choice(_ENDS)}", lambda: f"{self.word()}::{self.word()}", lambda: f"{r.randint(1, 20)}:{r.randint(1, 20)}:{r.randint(1, 20)}", lambda: f"std::{self.word()}", lambda: "".join(r.choices("0123456789abcdef", k=r.choice([32, 40]))), lambda: f"{r.randint(1, 30)} dot {r.randint(1, 9)}",
                lambda: f"{self.digits(3)}-{self.digits(2)}-{self.digits(2)}", lambda: f"{r.randint(1, 30)}. {self.word()} {r.randint(1, 30)}. {self.word()}", lambda: f"{self.word()}@{self.word()}", lambda: f"({y}) {self.digits(2)}-{self.digits(2)}", lambda: f"{self.digits(3)} {self.digits(3)} {self.digits(3)}", lambda: f"{self.digits(r.randint(3, 5))}-{self.digits(r.randint(3, 5))}",
                lambda: f"{self.word()} {r.choice(['dot', 'punkt', 'point', 'punto'])} {self.word()}", lambda: f"{r.randint(1, 9)} x {r.randint(1, 9)} / {r.randint(10, 99)}", lambda: f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)} {r.randint(100, 999)}", lambda: " ".join(self.digits(1) for _ in range(r.randint(7, 14))),
            ]
        )()

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        r, out, spans = self.r, self.words(0, 12), []
        for _ in range(r.choice([1, 2, 3, 4])):
            kind = r.choice(["email", "ip", "card", "phone", None, None, None, None])
            cue = r.choice(_CUES[kind]) if kind and r.random() < 0.55 else r.choice(_OTHER) if not kind and r.random() < 0.5 else ""
            if r.random() < 0.05:
                cue = r.choice([w for k in _CUES for w in _CUES[k]])
            if cue:
                out += " " + (cue.capitalize() if r.random() < 0.4 else cue) + r.choice([": ", " ", " is ", " = ", ". "]).rstrip(" ") * (r.random() < 0.6)
            out += r.choice([" ", " ", " ", "\n", " (", " <", '"', ", "]) if out else ""
            value = getattr(self, kind)() if kind else self.other()
            if kind:
                spans.append((kind, len(out), len(out) + len(value)))
            out += value + r.choice([" ", " ", ". ", ", ", ") ", "\n", "; ", "! "]) + self.words(0, 14)
        return (out.upper() if r.random() < 0.05 else out), spans


def sample_texts(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans of (kind, start, end) that the strict patterns don't cover)."""
    maker = _Maker(seed)
    return [maker.text() for _ in range(n)]
