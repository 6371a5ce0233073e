"""Labelled practice table: invented prose and mail whose parts and personal data are known.

Written without regard to any table: its wordings, names and words are everyday ones. A place of personal data is
written ``⟦kind|text⟧``. The models of mail parts and personal data start from it.
"""

from __future__ import annotations

import re

import numpy as np

GIVEN = (
    "Anna Peter Maria Thomas Julia Robert Laura Michael Sophie Daniel Emma David Clara Martin Elena Paul Alice George Irene Victor Helen Frank Simon Rosa Hugo Marta "
    "Louis Karin Stefan Ingrid Pierre Camille Antoine Lucia Carlos Teresa Pedro Luisa Miguel Beatriz Heike Monika Wolfgang Kurt Yusuf Priya Kenji Olga Dmitri Aisha"
).split()
SURNAMES = (
    "Smith Miller Johnson Brown Taylor Wilson Clark Walker Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Moreau Laurent Garnier Garcia Martinez Lopez "
    "Fernandez Navarro Silva Santos Pereira Costa Almeida Novak Kowalski Jensen Larsson Yilmaz Sharma Tanaka Petrov Smith-Jones Rossi Murphy"
).split()
MARK = re.compile("⟦([a-z_]+)\\|([^⟧]*)⟧")

# {p} person or other people, {c} contact, {w} thing, {x} product or place, {o} organization, {n} number, {k} other identifier
FRAMES = {
    "en": [
        "Yesterday {p} showed us a new {w} from {x}.", "I asked {p} whether our {w} could be repaired by Monday.", "My {w} broke after {n} weeks of heavy use.",
        "Nobody at {o} would tell {p} what this {w} costs.", "Write to {c} if your {w} arrives late.", "Mail us at {c} at any hour.", "Her number used to be {c} until May.", "They had {c} printed on the label.", "For questions call {c} before noon.", "You find my details below: {c}",
        "The form listed {c} under my old address.", "We bought our {w} in {x} during a sale.", "{p} thinks that buying {w} parts from {x} is foolish.", "Our {w} needs {n} hours to cool down.",
        "It seems {x} stopped selling every {w} they had.", "Does anybody know whether {p} will bring a {w} along?", "Please tell {p} that I found both keys.", "See {k} for a longer list.",
        "This was fixed in {k}, or so they claim.", "Most of us prefer tea over coffee while reading {k}.", "{p} and {p} met near {x} last autumn.", "Trains to {x} leave at {n} minutes past the hour.",
        "Let us know how your {w} behaves under rain.", "I would never lend a {w} to {p} again.", "They moved {n} boxes into the {w} room at {o}.", "When my {w} failed, {p} lent me hers.",
        "Grandmother kept her {w} beside an open window.", "Children played with a {w} until supper.", "{p} signed it.", "Ask {p} for help.",
    ],
    "de": [
        "Gestern zeigte uns {p} das neue {w} aus {x}.", "Ich fragte {p}, ob man mein {w} bis Montag reparieren könnte.", "Nach {n} Wochen ging mein {w} kaputt.", "Bitte ruft {c} an, wenn das Paket fehlt.",
        "Schreiben Sie an {c}, falls etwas unklar ist.", "Meine Daten lauten wie folgt: {c}", "Niemand bei {o} wollte {p} den Preis nennen.", "Wir kauften ein {w} in {x} für wenig Geld.",
        "{p} findet, dass jedes {w} von {x} zu schwer ist.", "Kommt {p} morgen auch mit dem Zug?", "Siehe dazu {k} im Anhang.", "{p} und {p} trafen sich letzten Herbst am See.", "Das {w} braucht {n} Stunden zum Abkühlen.",
        "Die Kinder spielten bis zum Abend mit einem {w}.",
    ],
    "fr": [
        "Hier {p} nous a montré un nouveau {w} de {x}.", "J'ai demandé à {p} si mon {w} serait réparé lundi.", "Mon {w} est tombé en morceaux après {n} semaines.", "Appelez {c} si le colis manque.",
        "Écrivez à {c} pour toute question.", "Mes coordonnées sont : {c}", "Chez {o}, personne n'a donné le prix à {p}.", "Nous avons acheté un {w} à {x} pendant les soldes.",
        "{p} trouve que chaque {w} de {x} pèse trop lourd.", "Est-ce que {p} viendra demain en train ?", "Voir aussi {k} en annexe.", "{p} et {p} se sont vus l'automne dernier.", "Les enfants ont joué avec un {w} jusqu'au soir.",
    ],
    "es": [
        "Ayer {p} nos enseñó un {w} nuevo de {x}.", "Pregunté a {p} si mi {w} estaría arreglado el lunes.", "Mi {w} se rompió a las {n} semanas.", "Llame a {c} si falta el paquete.",
        "Escriban a {c} para cualquier duda.", "Mis datos son estos: {c}", "En {o} nadie quiso decir el precio a {p}.", "Compramos un {w} en {x} durante las rebajas.", "{p} cree que cada {w} de {x} pesa demasiado.",
        "¿Vendrá {p} mañana en tren?", "Véase también {k} en el anexo.", "{p} y {p} se vieron el otoño pasado.", "Los niños jugaron con un {w} hasta la cena.",
    ],
    "pt": [
        "Ontem {p} mostrou-nos um {w} novo de {x}.", "Perguntei a {p} se o meu {w} estaria pronto na segunda.", "O meu {w} partiu-se ao fim de {n} semanas.", "Ligue para {c} se faltar a encomenda.",
        "Escrevam para {c} em caso de dúvida.", "Os meus dados são estes: {c}", "Na {o} ninguém quis dizer o preço a {p}.", "Comprámos um {w} em {x} durante os saldos.", "{p} acha que cada {w} de {x} pesa demais.",
        "Será que {p} vem amanhã de comboio?", "Ver também {k} em anexo.", "{p} e {p} encontraram-se no outono passado.", "As crianças brincaram com um {w} até ao jantar.",
    ],
}
WORDS = {
    "en": "kettle ladder bicycle lamp radio camera garden oven jacket piano kitchen carpet hammer printer clock mirror pump shelf basket wheel".split(),
    "de": "Fahrrad Regal Radio Klavier Messer Fenster Werkzeug Zelt Boot Sofa Telefon Hemd Buch Rad Dach".split(),
    "fr": "vélo tapis piano couteau marteau miroir four manteau panier bateau téléphone livre jardin réveil".split(),
    "es": "reloj espejo martillo horno abrigo cesto barco teléfono libro jardín cuchillo piano tapete".split(),
    "pt": "relógio espelho martelo forno casaco cesto barco telefone livro jardim tapete piano".split(),
}
OTHERS = {
    "en": ["my cousin", "the teacher", "her uncle", "our boss", "a student", "the captain"], "de": ["meine Tante", "der Lehrer", "unsere Chefin", "ein Student"],
    "fr": ["ma tante", "le professeur", "notre patronne", "un étudiant"], "es": ["mi tía", "el profesor", "nuestra jefa", "un alumno"], "pt": ["a minha tia", "o professor", "a nossa chefe", "um aluno"],
}
TITLES = ["Dr.", "Prof.", "Mr.", "Mrs.", "Ms.", "Herr", "Frau", "Dr", "Mr"]
STREETS = "Street St. St Road Rd. Rd Avenue Ave. Ave Lane Ln Drive Dr. Court Ct Way Close Square Boulevard Blvd".split()
OPEN = {
    "en": ["Hi,", "Hello there,", "Good morning everyone,", "Dear list,", "Hey folks!"], "de": ["Hallo,", "Guten Morgen,", "Liebe Runde,", "Moin!"], "fr": ["Bonsoir,", "Salut,", "Chers amis,"],
    "es": ["Hola,", "Buenos días:", "Queridos amigos:"], "pt": ["Olá,", "Bom dia,", "Caros amigos,"],
}
CLOSE = {
    "en": ["Regards,", "Kind regards", "Cheers,", "Thanks,", "Sincerely,", "Take care", "Bye,"], "de": ["Grüße", "Beste Grüße,", "Danke,", "MfG"], "fr": ["Salutations", "Merci,", "Bien à vous,"],
    "es": ["Gracias,", "Un abrazo", "Saludos,"], "pt": ["Obrigado,", "Abraços", "Atenciosamente,"],
}
NOTICES = {
    "en": [
        "Views expressed are personal and do not bind {o} in any way.", "CONFIDENTIALITY NOTICE: this e-mail is privileged. If you are not its intended recipient, notify the sender and destroy every copy.",
        "I do not speak for my employer {o}; all opinions are private.", "Unauthorised disclosure of this e-mail or its attachments is prohibited. {o} is not liable for viruses or loss.",
        "Standard disclaimer: {o} neither knows nor approves of these statements, which are no legal advice.",
    ],
    "de": ["Vertraulich: Sollten Sie nicht der vorgesehene Adressat sein, informieren Sie bitte den Absender und vernichten Sie diese E-Mail.", "Meine Meinung ist privat, {o} übernimmt keine Haftung."],
    "fr": ["Avis de confidentialité : si vous avez reçu ce courriel par erreur, prévenez l'expéditeur et détruisez-le.", "Opinions personnelles, {o} n'en est pas responsable."],
    "es": ["Aviso de confidencialidad: si ha recibido este correo por error, avise al remitente y elimínelo.", "Opiniones personales, {o} no es responsable de ellas."],
    "pt": ["Aviso de confidencialidade: se recebeu este correio por engano, avise o remetente e apague-o.", "Opiniões pessoais, pelas quais {o} não é responsável."],
}
HEADS = {
    "en": ("From: {f}", "Sent: {d}", "To: {e}", "Subject: {s}"), "de": ("Von: {f}", "Gesendet: {d}", "An: {e}", "Betreff: {s}"), "fr": ("De : {f}", "Envoyé : {d}", "À : {e}", "Objet : {s}"),
    "es": ("De: {f}", "Enviado: {d}", "Para: {e}", "Asunto: {s}"), "pt": ("De: {f}", "Enviada: {d}", "Para: {e}", "Assunto: {s}"),
}
INCLUDED = {
    "en": ["-----Original Message-----", "----- Forwarded by mail -----", "---------- Start of forwarded text ----------"], "de": ["-----Weitergeleitete Nachricht-----"], "fr": ["-----Message transféré-----"],
    "es": ["-----Mensaje reenviado-----"], "pt": ["-----Mensagem encaminhada-----"],
}
SAID = {
    "en": ["On {d}, {f} wrote:", "On {d} {f} wrote", "{f} wrote:", "{f} writes:", "{f} said:", "In article {k}, {f} wrote:", "In message {k} {f} writes:", "{f} wrote on {d}:"],
    "de": ["Am {d} schrieb {f}:", "{f} schrieb:", "{f} schrieb am {d}:"], "fr": ["Le {d}, {f} a écrit :", "{f} a écrit :"], "es": ["El {d}, {f} escribió:", "{f} escribió:"], "pt": ["Em {d}, {f} escreveu:", "{f} escreveu:"],
}


class Writer:
    """Writes practice lines; the same seed writes the same table."""

    def __init__(self, seed: int = 1):
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def digits(self, n: int) -> str:
        return "".join(str(int(x)) for x in self.rng.integers(0, 10, n))

    def name(self) -> str:
        """An unknown capitalised word."""
        onset, vowel, coda = "b br c ch d dr f fl g gr h j k kl l m n p pl r s st t tr v w z".split(), "a e i o u ai ea ou".split(), ["", "", "n", "r", "l", "s", "t", "x", "m", "nd", "rk", "st"]
        return "".join(self.pick(onset) + self.pick(vowel) + self.pick(coda) for _ in range(int(self.rng.integers(2, 4)))).capitalize()

    def thing(self) -> str:
        return self.name() + self.pick(["", "", "", f" {self.rng.integers(2, 999)}", f"-{self.pick('ABCDEFGX')}{self.rng.integers(1, 99)}"])

    def org(self) -> str:
        return f"{self.name()} {self.pick('Inc. Corp. Ltd. University College Institute Group Systems Research GmbH AG SA Lda. Labs Software Electronics'.split())}"

    def person(self) -> tuple[str, str]:
        return self.pick(GIVEN) if self.chance(0.6) else self.name(), self.pick(SURNAMES) if self.chance(0.4) else self.name()

    def shown(self, given: str, last: str, listed: bool = False) -> str:
        form = self.pick(["{g} {s}"] * 5 + ["{g}", "{g} {i}. {s}", "{h}. {s}", "{t}", "{t}"] + (["{s}, {g}"] * 2 if listed else []))
        if form == "{t}":
            return f"{self.pick(TITLES)} ⟦person_name|{last}⟧"
        text = form.format(g=given, s=last, i=self.pick("ABCDEFGHJKLMNPRSTW"), h=given[0])
        return f"⟦person_name|{text.lower() if self.chance(0.05) else text.upper() if self.chance(0.04) else text}⟧"

    def host(self) -> str:
        return ".".join([self.name().lower(), *self.pick([["com"], ["org"], ["net"], ["example"], ["example", "com"], ["edu"], ["ac", "uk"], ["de"], ["example", "org"], ["test"], ["invalid"]])])

    def address(self, given: str, last: str) -> str:
        g, s = given.lower(), last.lower().replace("-", "")
        return self.pick([f"{g}.{s}", f"{g}_{s}", f"{s}{self.rng.integers(1, 99)}", f"{g[0]}{s}", f"{g}{s[0]}", f"{g}+list", f"{g}-{s}"]) + "@" + self.host()

    def email(self, given: str, last: str, spelt: bool = True) -> str:
        mail = self.address(given, last)
        if spelt and self.chance(0.35):
            at, dot = self.pick([(" (at) ", "."), ("(at)", "."), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", " dot "), (" (at) ", " (dot) "), ("[AT]", "[DOT]"), (" [at] ", " [dot] ")])
            user, _, host = mail.partition("@")
            mail = user + at + host.replace(".", dot)
        return f"⟦email|{mail.upper() if spelt and self.chance(0.06) else mail}⟧"

    def phone(self) -> str:
        d = self.digits
        a, b = str(self.rng.integers(200, 999)), str(self.rng.integers(200, 999))
        text = self.pick(
            [f"({a}) {b}-{d(4)}", f"{a}-{b}-{d(4)}", f"{a}.{b}.{d(4)}", f"{a}{b}{d(4)}", f"+1 {a} {b} {d(4)}", f"1-{a}-{b}-{d(4)}", f"{a}/{b}-{d(4)}", f"020 7{d(3)} {d(4)}", f"+44 20 7{d(3)} {d(4)}", f"0{d(3)} {d(6)}",
             f"0{d(2)}/{d(5)} {d(3)}", f"0{d(3)}/{d(6)}", f"+49 {d(2)} {d(8)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+351 {d(3)} {d(3)} {d(3)}"]
        )
        return f"⟦phone|{text}⟧"

    def number(self) -> str:
        d, letter = self.digits, self.pick("ABCDEGHJKLMNPRSTXYZ")
        labels, text = self.pick(
            [(["SSN", "social security number", "social security no."], f"{d(3)}-{d(2)}-{d(4)}"), (["SSN", "Social Security"], f"{d(3)} {d(2)} {d(4)}"), (["NI number", "National Insurance"], f"{letter}Z {d(2)} {d(2)} {d(2)} {self.pick('ABCD')}"),
             (["NI number", "NINO"], f"{letter}B{d(6)}{self.pick('ABCD')}"), (["passport", "passport no.", "Reisepass", "passeport", "pasaporte"], f"{letter}{d(8)}"), (["Ausweisnummer", "Personalausweis", "ID card"], f"{letter}{d(2)}{self.pick('KLMX')}{d(5)}"),
             (["tax id", "Steuernummer", "tax number"], d(11)), (["DNI", "NIE"], f"{d(8)}-{letter}"), (["DNI"], f"{d(8)}{letter}"), (["NIF", "contribuinte"], d(9))]
        )
        return f"{self.pick(labels)}{self.pick([' is ', ': ', ' # ', ' ', ' = '])}⟦id_number|{text}⟧"

    def street(self) -> str:
        n, x, y = int(self.rng.integers(1, 990)), self.name(), self.name()
        text = self.pick(
            [f"{n} {x} {self.pick(STREETS)}"] * 4 + [f"{n} {self.pick(['Old', 'New', 'North', 'West'])} {x} {self.pick(STREETS)}"] * 2 + [f"{n} rue {self.pick(['', 'de ', 'du '])}{x}", f"{n}, rue {x}", f"{n} bis, rue {x}", f"{n} bis, avenue {x}", f"{n} avenue {x}"]
            + [f"Calle {x} {n}", f"Calle {x}, {n}", f"Avenida {x}, {n}", f"Rua {x}, {n}", f"Rua {x} {n}", f"Avenida {x} {n}"] + [f"{x}straße {n}", f"{x}strasse {n}", f"{x}str. {n}", f"{x}weg {n}", f"{x}gasse {n}", f"{x}platz {n}"]
        )
        return f"⟦street_address|{text}⟧{self.pick(['', '', ', ' + y, f', Apt {self.rng.integers(1, 60)}', f', {self.digits(5)} {y}'])}"

    def contact(self) -> str:
        given, last = self.person()
        return self.pick([self.email, self.email, lambda *_: self.phone(), lambda *_: self.number(), lambda *_: self.street()])(given, last)

    def identifier(self) -> str:
        """What looks like personal data and is none."""
        d = self.digits
        return self.pick(
            [f"<{d(6)}.{d(3)}@{self.host()}>", f"version {d(1)}.{d(1)}.{d(3)}", f"v{d(1)}.{d(2)}", f"ISBN {d(1)}-{d(4)}-{d(4)}-{d(1)}", f"(ISBN {d(13)})", f"ref. {d(3)}-{d(2)}-{d(4)}-{d(1)}", f"(ref {d(3)}-{d(2)}-{d(4)}-{d(1)})", f"invoice {d(7)}",
             f"ftp://ftp.{self.host()}/pub/{self.name().lower()}", f"http://www.{self.host()}/{self.name().lower()}.html", f"{self.host()}", "!".join(self.name().lower() for _ in range(5)), f"[{self.rng.integers(2, 99)} {self.name()} points]", f"{self.rng.integers(2, 99)} {self.name()} stamps"]
        )

    def stray(self) -> str:
        """A place, or what looks like one, among words without a bearing on it."""
        lang = self.pick(list(FRAMES))
        loose = [w for frame in FRAMES[lang] for w in re.findall(r"(?<![{\w])[^\W\d_]+(?![}\w])", frame)] + WORDS[lang]

        def some() -> str:
            return " ".join(self.pick(loose) if self.chance(0.7) else self.name() if self.chance(0.5) else self.name().lower() for _ in range(int(self.rng.integers(0, 5))))

        given, last = self.person()
        n = self.rng.integers
        kind = self.pick(["name", "name", "email", "phone", "phone", "number", "street", "street", "none", "none"])
        value = {
            "name": lambda: self.shown(given, last, listed=True), "email": lambda: self.email(given, last), "phone": self.phone, "number": self.number, "street": self.street,
            "none": lambda: self.pick([self.identifier(), self.thing(), str(n(1, 9999)), f"{n(1, 99)}.{n(1, 99)}", f"{n(1, 99)}-{n(1, 99)}", f"{self.name()} {self.name()}", self.date(), self.org(), f"{n(1, 13)}:{n(10, 60)}"]),
        }[kind]()
        return f"{some()}{self.pick([' ', ' ', ': ', ', ', chr(10), ' ('])}{value}{self.pick(['', ' ', '.', ', ', chr(10), ') '])}{some()}"

    def sentence(self, lang: str) -> str:
        out = self.pick(FRAMES[lang])
        while (m := re.search(r"\{(\w)\}", out)) is not None:
            value = {
                "w": lambda: self.pick(WORDS[lang]), "x": self.thing, "n": lambda: str(self.rng.integers(2, 4999)), "c": self.contact, "o": self.org, "k": self.identifier,
                "p": lambda: self.shown(*self.person(), listed=True) if self.chance(0.65) else self.pick(OTHERS[lang]),
            }[m.group(1)]()
            out = out[: m.start()] + value + out[m.end() :]
        return out[0].upper() + out[1:]

    def date(self) -> str:
        n = self.rng.integers
        month = self.pick("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())
        return self.pick([f"{n(1, 29)} {month} 2001", f"{n(1, 29)}.{n(1, 13)}.99", f"{n(1, 29)} {month} 98", f"Tue, {n(1, 29)} {month} 1999 {n(10, 24)}:{n(10, 60)}:{n(10, 60)} GMT", f"{month} {n(1, 29)}, 2003 at {n(1, 13)}:{n(10, 60)} PM", f"{n(1, 29)}/{n(1, 13)}/2004"])

    def wrapped(self, text: str, width: int) -> list[str]:
        """Lines of at most about ``width`` shown characters; a marked place is never split."""
        units = re.findall("(?:⟦[^⟧]*⟧|[^\\s⟦])+", text)
        lines, line, used = [], "", 0
        for u in units:
            size = len(MARK.sub(lambda m: m[2], u))
            if line and used + 1 + size > width:
                lines.append(line)
                line, used = "", 0
            line = f"{line} {u}" if line else u
            used += size + 1
        return [*lines, line] if line else lines

    def identity(self, given: str, last: str, listed: bool = True) -> str:
        """A correspondent as mailers show one."""
        who, mail = self.shown(given, last, listed=listed), self.email(given, last, spelt=False)
        return self.pick([who, who, f"{who} <{mail}>", f"{who} ({mail})", f"{mail} ({who})", mail])

    def said_by(self, lang: str) -> list[str]:
        line = self.pick(SAID[lang]).format(d=self.date(), f=self.identity(*self.person()), k=f"<{self.digits(7)}.{self.digits(3)}@{self.host()}>")
        if self.chance(0.3):
            # a mailer broke it; never within a place
            at = [m.start() for m in re.finditer(" ", line) if line[: m.start()].count("⟦") == line[: m.start()].count("⟧")]
            cuts = sorted(self.rng.choice(at, min(len(at), int(self.rng.integers(1, 3))), replace=False).tolist()) if at else []
            edges = [0, *(c + 1 for c in cuts), len(line) + 1]
            return [line[a : b - 1] for a, b in zip(edges, edges[1:])]
        return [line]

    def post(self) -> list[tuple[str, str]]:
        """(line, part) of one mail: H header, A written anew, Q quoted or included, S closing and signature, D notices."""
        lang = self.pick(["en"] * 5 + ["de", "fr", "es", "pt"])
        given, last = self.person()
        mail, who = self.email(given, last, spelt=False), f"⟦person_name|{given} {last}⟧"
        out: list[tuple[str, str]] = []

        def add(part: str, *lines: str) -> None:
            out.extend((line, part) for line in lines)

        def prose(n: int) -> str:
            return " ".join(self.sentence(lang) for _ in range(n))

        def blank(p: float = 0.8) -> None:
            if self.chance(p):
                add(out[-1][1] if out else "A", *[""] * (1 + self.chance(0.15)))

        subject = self.pick(["", "Re: ", "Fwd: "]) + f"{self.pick(WORDS[lang])} / {self.pick(WORDS[lang])}"
        head = ["From: " + self.pick([f"{who} <{mail}>", f"{mail} ({who})", mail, who]), self.pick(["Subject: ", "SUBJECT: "]) + subject, f"Date: {self.date()}", f"Message-ID: <{self.digits(8)}.{self.digits(3)}@{self.host()}>"]
        head += [f"Newsgroups: {self.name().lower()}.{self.name().lower()}"] * self.chance(0.5) + [f"Lines: {self.rng.integers(2, 80)}"] * self.chance(0.4) + [f"Organization: {self.org()}"] * self.chance(0.4)
        head += [f"Reply-To: {mail}"] * self.chance(0.3) + [f"To: {self.identity(*self.person())}"] * self.chance(0.3) + [f"X-Mailer: {self.thing()}"] * self.chance(0.2)
        if self.chance(0.85):
            self.rng.shuffle(head)
            add("H", *head, self.pick(["", "", "  "]))

        def authored(n: int) -> None:
            shape = self.rng.random()
            if shape < 0.15:
                marks = self.pick([["- "], ["* "], ["1) ", "2) ", "3) "], ["1. ", "2. ", "3. "]])
                for k in range(n):
                    lines = self.wrapped(self.sentence(lang), 70)
                    add("A", marks[k % len(marks)] + lines[0], *("   " + x for x in lines[1:]))
            elif shape < 0.27:
                pad = " " * int(self.rng.integers(2, 7))
                add("A", *(pad + x for x in self.wrapped(prose(n), 64)))
            elif shape < 0.45:
                add("A", prose(n))
            elif shape < 0.52:
                add("A", self.pick(["while (x > 1) x = x / 2;", "a[i] > b[i] for all i", "if size > 10: stop here"]), *self.wrapped(prose(n), 70))
            else:
                add("A", *self.wrapped(prose(n), int(self.rng.integers(50, 78))))

        def quoted(n: int, intro: bool) -> None:
            if intro:
                add("Q", *self.said_by(lang))
                blank(0.1)
            initials = self.pick("ABCDEFGHJKLMNPRSTW") + self.pick("ABCDEFGHJKLMNPRSTW")
            mark = self.pick(["> ", "> ", ">", ">> ", "> > ", "| ", "} ", ": ", initials + "> ", " > ", "|", "}"] + ["     ", "    "] * intro)
            for line in self.wrapped(prose(n), int(self.rng.integers(46, 68))):
                words = line.split(" ")
                if mark.strip() and len(words) > 4 and self.chance(0.1) and "⟦" not in line:
                    cut = int(self.rng.integers(1, 4))
                    add("Q", mark + " ".join(words[:-cut]), " ".join(words[-cut:]))
                elif mark.strip() and self.chance(0.04):
                    add("Q", ">" + mark + line)
                else:
                    add("Q", mark + line)
            if mark.strip() and self.chance(0.3):
                add("Q", mark.rstrip())

        if self.chance(0.4):
            add("A", self.pick(OPEN[lang]) if self.chance(0.55) else self.pick(["", "", "Hi ", "Hello ", "Dear ", "Salut ", "Hola ", "Hallo "]) + f"⟦person_name|{self.person()[0]}⟧" + self.pick([",", ",", "!", ":"]))
            blank(0.4)
        for _ in range(int(self.rng.integers(1, 4))):
            kind = self.rng.random()
            if kind < 0.45:
                quoted(int(self.rng.integers(1, 4)), self.chance(0.75))
                blank(0.75)
            if kind < 0.9:
                authored(int(self.rng.integers(1, 4)))
                blank()
        if out and all(p != "A" for _, p in out):
            authored(2)
            blank()
        if self.chance(0.6):
            sign = self.pick([given, f"{given} {last}", f"{given[0]}. {last}"])
            add("S", *[self.pick(CLOSE[lang])] * self.chance(0.9), self.pick(["", "", "-", "- ", "  "]) + f"⟦person_name|{sign}⟧")
            blank(0.6)
        if self.chance(0.12):
            add("A", self.pick(["P.S. ", "PS: ", "PS ", "P.S.: "]) + self.sentence(lang))
            blank(0.5)
        if self.chance(0.5):
            add("S", self.pick(["--", "-- ", "-- ", "_" * 24, "*" * 30, "=" * 36, "-=-=-=-=-=-", "~~~ " + self.name() + " mail v2.0", who]))
            lines = [who if self.chance(0.6) else f"{who} | {self.org()}"] + [self.org()] * self.chance(0.7)
            lines += [self.pick(["phone: ", "Tel. ", "Phone ", "Voice: ", "tel: ", "Ph: ", ""]) + self.phone()] * self.chance(0.5)
            lines += [self.pick(["e-mail: ", "mail: ", "Email: ", ""]) + mail] * self.chance(0.6) + [self.street()] * self.chance(0.4)
            lines += [f'"{MARK.sub(lambda m: m[2], self.sentence(lang))}"'] * self.chance(0.35)
            if self.chance(0.35):
                glue = self.pick([" | ", " / ", "   "])
                lines = [glue.join(lines[i : i + 2]) for i in range(0, len(lines), 2)]
            add("S", *lines)
            blank(0.4)
        if self.chance(0.3):
            add("D", *self.wrapped(self.pick(NOTICES[lang]).format(o=self.org()), int(self.pick([58, 66, 74, 300]))))
            blank(0.3)
        late = self.rng.random()
        if late < 0.12:
            other = self.person()
            f, d, e, s = HEADS[lang]
            add("Q", self.pick(INCLUDED[lang]), f.format(f=self.identity(*other)), d.format(d=self.date()), *[e.format(e=mail)] * self.chance(0.7), s.format(s=subject), "", *self.wrapped(prose(2), 66))
            if self.chance(0.4):
                add("Q", "", self.pick(CLOSE[lang]), self.pick(["-", ""]) + f"⟦person_name|{other[0]}⟧")
        elif late < 0.3:
            quoted(int(self.rng.integers(1, 4)), self.chance(0.5))
        if self.chance(0.15):
            add("D", self.pick([f"To unsubscribe send mail to {self.name().lower()}-request", f"You receive this through {self.name().lower()}-request", f"Sent through the {self.name()} gateway", f"Subscriptions: {self.name().lower()}-request@{self.host()}"]))
        if self.chance(0.12):
            add("D", "-----BEGIN PGP SIGNATURE-----", *("".join(self.pick("ABCDEFGHabcdefgh0123456789+/") for _ in range(48)) for _ in range(2)), "-----END PGP SIGNATURE-----")
        return out


def unmarked(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, places as (start, end, kind)) of a marked line."""
    out, at, places = "", 0, []
    for m in MARK.finditer(line):
        out += line[at : m.start()]
        places.append((len(out), len(out) + len(m[2]), m[1]))
        out += m[2]
        at = m.end()
    return out + line[at:], places
