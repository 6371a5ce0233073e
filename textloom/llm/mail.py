"""The newly written text of mails: a semi-Markov model over runs of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.practice import Writer, unmarked

PARTS = ["H", "A", "Q", "S", "D"]  # header, authored, quoted or included, closing and signature, notices and added lines
LONGEST = 48  # lines of a run that the model scores at once; longer runs are several
POSTS = 700
_SPLIT = re.compile(r"\r?\n")
_MAIL = re.compile(r"[\w.+-]+@[\w.-]+")
_HEAD = re.compile(r"^[A-Za-zÀ-ÿ][\w-]{1,20} ?: ?\S")
_MARK = re.compile(r"^ ?(?:[>|}]|: |[A-Z]{1,3}> ?)")
_VERBS = re.compile(r"\b(wrote|writes|said|put it|quoting|schrieb|zitat|a écrit|escribió|escreveu|écrit)\b", re.I)
_DELIMITER = re.compile(r"^(--\s*|[_*=~#+-]{6,}\s*|~~~.*)$")
_INCLUDED = re.compile(r"^-{3,} ?\S.*\S ?-{3,}$")
_NAME = re.compile(r"^\s*-?\s*(?:[A-ZÀ-Ý][\w'-]+|[A-Z]\.)(?: (?:[A-Z]\.|[A-ZÀ-Ý][\w'-]+)){0,2}\s*$")
# fixed values: usual greetings, closing formulas and words of notices in the five languages
_OPENING = re.compile(
    r"(hi|hello|hey|dear|greetings|good (morning|afternoon|evening|day)|hallo|guten (tag|morgen|abend)|liebe[rs]?|sehr geehrte[r]?|servus|moin|bonjour|bonsoir|salut|chère?s?|coucou"
    r"|hola|buen[oa]s (días|tardes|noches)|estimad[oa]s?|querid[oa]s?|olá|oi|bom dia|boa (tarde|noite)|car[oa]s?|prezad[oa]s?)\b"
)
_CLOSING = re.compile(
    r"((with |my )?(best|kind|warm|many)? ?(regards|wishes)|sincerely|yours( truly| sincerely| faithfully)?|cheers|(many )?thanks( in advance| again| a lot)?|thank you|take care|later|see you|ttfn|ciao|bye|greetings"
    r"|mit (freundlich|best|herzlich|lieb)en grüßen|mit (freundlich|best)em gruß|(viele|liebe|beste|schöne)? ?grüße|gruß|mfg|lg|tschüs+|bis (bald|dann|später)|danke"
    r"|(bien )?cordialement|amicalement|bien à vous|[àa] bient[ôo]t|(meilleures )?salutations|merci( d'avance)?|(un |muchos )?saludos?( cordiales)?|(muy )?atentamente|(un |um )?abra[zç]os?|gracias|hasta (luego|pronto)"
    r"|(com os melhores )?cumprimentos|atenciosamente|obrigad[oa]|até (breve|logo))[ ,.!]*"
)
_NOTICE = re.compile(
    r"\b(opinions?|views|employer|disclaimer|confiden\w+|privileged|intended|recipient|addressee|notify|sender|liab\w+|responsib\w+|legal|advice|attachments?|unauthori[sz]ed|disclosure|delete|destroy|mistake|owners|staff"
    r"|vertraulich|empfänger|adressat\w*|irrtümlich\w*|löschen|vernichten|absender|haftung|meinung|nachricht|confidentiel\w*|destinataire|erreur|détrui\w+|expéditeur|responsab\w+|réservé"
    r"|confidencia\w*|destinat[aá]rio|error|elim\w+|remit\w+|remetente|engano|apag\w+|opini\w+)\b"
)
_ORG = re.compile(r"\b[A-Z][\w-]+ (Inc|Corp|Ltd|Lda|GmbH|AG|SA|SL|University|College|Institute|Lab\w*|Systems|Research|Group|Software|Electronics|Computing|Works|Company)\b")


def lines_of(text: str) -> list[str]:
    return _SPLIT.split(text)


def _kind(line: str) -> str:
    """Shape class of a line, by its boundary cues."""
    body = line.strip()
    if not body:
        return "blank"
    if body == "--" or _DELIMITER.match(body):
        return "delimiter"
    if body.startswith("-----BEGIN") or body.startswith("-----END") or body.lower().startswith("-----end"):
        return "armour"
    if _INCLUDED.match(body):
        return "included"
    if _MARK.match(line) and not re.match(r"^ ?: ?\)", line):
        return "marked"
    low = body.lower()
    if _VERBS.search(low) and (low.endswith(":") or low.endswith("wrote") or re.search(r"\d[\d:. ]*\w* ?\w*$", low) and len(low) < 70):
        return "attribution"
    if _CLOSING.fullmatch(low):
        return "closing"
    if len(low) < 40 and (_OPENING.match(low) and re.search(r"[,:!]$", low) or re.match(r"^[A-ZÀ-Ý][\w-]+[,:!]$", body)):
        return "opening"
    if _HEAD.match(body) and not re.match(r"^(p\.?s|contact|kontakt|contacto)", low):
        if re.match(r"^(ph|phone|tel|voice|fax|net|e-?mail|internet|mail|web)\b", low):
            return "field"
        return "header"
    if re.match(r"^p\.? ?s\b", low):
        return "postscript"
    if re.match(r"^(ph#|voice|phone|tel\.?|e-?mail|net|fax)\b", low):
        return "field"
    if _MAIL.fullmatch(body.strip("<>()")):
        return "address"
    if _MAIL.search(body) and len(body) < 70 and body.endswith((":", ")", ">")):
        return "addressed"
    if _NAME.match(line):
        return "name"
    if re.search(r"\b\w+-request\b", low) and len(low) < 70:
        return "list"
    if (told := len(set(_NOTICE.findall(low)))) >= 2 and told * 40 >= len(low):
        return "notice"
    if re.match(r"^[-*•] |^\d+[.)] ", body):
        return "item"
    if body[0] in "\"'“" and body[-1] in "\"'”" and len(body) > 8:
        return "motto"
    if len(body) < 60 and re.search(r"\d", body) and not re.search(r"[.!?]$", body) and len(re.findall(r"[a-zà-ÿ]{3,}", body)) <= 4:
        return "numbered"
    if len(body) < 48 and re.fullmatch(r"[A-Z][\w-]+(?: [A-Z][\w.-]+)+", body):
        return "titled"
    if re.search(r"[|]", body) and len(body) < 80:
        return "barred"
    if line.startswith("    "):
        return "indented"
    return "prose"


def _start(line: str) -> str:
    return "u" if line[:1].isupper() else "l" if line[:1].islower() else "i" if line[:1].isspace() else "o"


class Mail:
    """A text as its non-blank lines with the cues the model uses."""

    def __init__(self, text: str):
        every = lines_of(text)
        self.number = [i for i, x in enumerate(every) if x.strip()]
        self.lines = [every[i] for i in self.number]
        self.kind = [_kind(x) for x in self.lines]
        self.gap = [i == 0 or not every[i - 1].strip() for i in self.number]  # blank before
        n = len(self.lines)
        first_blank = next((i for i, x in enumerate(every) if not x.strip()), len(every))
        self.headed = [i < first_blank and k in ("header", "field", "indented", "prose", "addressed") for i, k in zip(self.number, self.kind)]
        self.block = bool(n) and self.headed[0] and self.kind[0] in ("header", "field")
        self.notice = self._notices()
        ends = [x.rstrip()[-1:] in ".!?:;…\"')]" for x in self.lines]
        self.emit: list[list[str]] = []
        after_included = included = after_delimiter = False
        after_closing = False
        for t in range(n):
            k = self.kind[t]
            before = self.kind[t - 1] if t else "start"
            after = self.kind[t + 1] if t + 1 < n else "end"
            if k in ("included",):
                included = True
            if k == "delimiter":
                after_delimiter = True
            size = "s" if len(self.lines[t]) < 30 else "m" if len(self.lines[t]) < 55 else "l"
            pad = len(self.lines[t]) - len(self.lines[t].lstrip())
            f = [k, f"{k}<{before}", f"{k}>{after}", f"{k}|{self.gap[t]:d}", f"{k}|{size}", f"{k}|start{_start(self.lines[t])}", f"pad{min(pad, 5)}|{before}|{self.gap[t]:d}"]
            f.append(f"head{self.headed[t] and self.block:d}")
            f.append(f"block{self.notice[t]}|{k == 'notice':d}")
            f.append(f"told{min(2, len(_NOTICE.findall(self.lines[t].lower()))):d}|{self.gap[t]:d}|{before}")
            f.append(f"inc{included:d}{k}")
            f.append(f"sig{after_delimiter:d}|{k}|{self.gap[t]:d}")
            f.append(f"close{after_closing:d}|{k}|{self.gap[t]:d}")
            if before in ("marked",) and k not in ("marked",) and not self.gap[t]:
                f.append(f"torn{after == 'marked':d}{size}{ends[t]:d}{_start(self.lines[t])}")
            if before in ("attribution", "addressed") and pad >= 2:
                f.append(f"inset{self.gap[t]:d}")
            f.append(f"tail{min(3, n - 1 - t)}{k}")
            self.emit.append(f)
            if k == "closing":
                after_closing = True
            elif self.gap[t] and k in ("prose", "marked", "attribution", "postscript", "included"):
                after_closing = False
                after_delimiter = False

    def _notices(self) -> list[str]:
        """For each line how much its paragraph sounds like a notice: its words, whether it names an organization, its size."""
        out: list[str] = []
        lo = 0
        for t in range(1, len(self.lines) + 1):
            if t == len(self.lines) or self.gap[t] or (self.kind[t] in ("marked", "armour", "delimiter", "attribution")) != (self.kind[lo] in ("marked", "armour", "delimiter", "attribution")):
                text = " ".join(self.lines[lo:t])
                out += [f"{min(4, len(set(_NOTICE.findall(text.lower()))))}{bool(_ORG.search(text)):d}{'s' if len(text) < 120 else 'm' if len(text) < 240 else 'l'}"] * (t - lo)
                lo = t
        return out

    def whole(self, lo: int, hi: int, part: str) -> list[str]:
        """Features of lines lo..hi - 1 as one run: its length, borders and make-up."""
        n = hi - lo
        kinds = self.kind[lo:hi]
        out = [f"len{1 if n == 1 else 2 if n == 2 else 4 if n <= 4 else 8 if n <= 8 else 16}", f"first|{kinds[0]}", f"last|{kinds[-1]}", f"gap|{self.gap[lo]:d}"]
        out.append(f"next|{self.kind[hi] if hi < len(self.kind) else 'end'}|{self.gap[hi] if hi < len(self.kind) else True:d}")
        if part == "Q":
            marked = sum(k == "marked" for k in kinds)
            out.append(f"marked{'none' if not marked else 'all' if marked == n else 'some'}")
            out.append(f"intro{kinds[0] in ('attribution', 'addressed', 'included', 'name'):d}")
        if part == "S":
            out.append(f"lead|{kinds[0]}|{self.gap[lo]:d}")
        return out


class SemiMarkov:
    def __init__(self):
        self.w: dict[str, np.ndarray] = {}
        self.sum: dict[str, np.ndarray] = {}
        self.move = np.zeros((len(PARTS) + 1, len(PARTS)))
        self.move_sum = np.zeros_like(self.move)
        self.steps = 0

    def _row(self, feature: str) -> np.ndarray:
        return self.w.get(feature, _ZERO)

    def decode(self, mail: Mail) -> list[tuple[int, int, int]]:
        """Best segmentation (start, end, part): scores of lines, of whole runs and of moves between parts."""
        n = len(mail.lines)
        if not n:
            return []
        line = np.array([sum((self._row("l" + f) for f in fs), _ZERO) for fs in mail.emit])
        total = np.vstack([_ZERO, np.cumsum(line, 0)])
        best = np.full((n + 1, len(PARTS)), -np.inf)
        back = np.zeros((n + 1, len(PARTS), 2), int)
        cache = self.w.get
        lead = [[cache(f"rfirst|{k}", _ZERO) + cache(f"rgap|{g:d}", _ZERO) + cache(f"rlead|{k}|{g:d}", _ZERO) * _IS_S for k, g in zip(mail.kind, mail.gap)]][0]
        intro = [cache(f"rintro{k in ('attribution', 'addressed', 'included', 'name'):d}", _ZERO) * _IS_Q for k in mail.kind]
        tail = []
        for t in range(n):
            nxt = mail.kind[t + 1] if t + 1 < n else "end"
            gap = mail.gap[t + 1] if t + 1 < n else True
            tail.append(cache(f"rlast|{mail.kind[t]}", _ZERO) + cache(f"rnext|{nxt}|{gap:d}", _ZERO))
        lengths = {k: cache(f"rlen{k}", _ZERO) for k in (1, 2, 4, 8, 16)}
        marks = {k: cache(f"rmarked{k}", _ZERO) * _IS_Q for k in ("none", "some", "all")}
        count = np.r_[0, np.cumsum([k == "marked" for k in mail.kind])]
        head = np.array(lead) + np.array(intro) - total[:-1]
        size_of = np.minimum(LONGEST, np.arange(LONGEST + 1))
        by_size = np.array([lengths[1 if z <= 1 else 2 if z == 2 else 4 if z <= 4 else 8 if z <= 8 else 16] for z in size_of])
        mark_rows = np.array([marks["none"], marks["some"], marks["all"]])
        enter = np.zeros((n, len(PARTS)))
        source = np.full((n, len(PARTS)), -1)
        enter[0] = self.move[-1]
        for hi in range(1, n + 1):
            at = np.arange(max(0, hi - LONGEST), hi)
            m = count[hi] - count[at]
            score = enter[at] + head[at] + by_size[hi - at] + mark_rows[np.where(m == 0, 0, np.where(m == hi - at, 2, 1))]
            pick = score.argmax(0)
            best[hi] = score[pick, _EACH] + total[hi] + tail[hi - 1]
            back[hi, :, 0] = at[pick]
            back[hi, :, 1] = source[at[pick], _EACH]
            if hi < n:
                every = best[hi][:, None] + self.move[:-1]
                source[hi] = every.argmax(0)
                enter[hi] = every[source[hi], _EACH]
        out, hi, part = [], n, int(best[n].argmax())
        while hi > 0:
            lo, before = back[hi, part]
            out.append((int(lo), hi, part))
            hi, part = int(lo), int(before)
        return out[::-1]

    def _features(self, mail: Mail, runs: list[tuple[int, int, int]]) -> dict[tuple[str, int], int]:
        out: dict[tuple[str, int], int] = {}
        for lo, hi, part in runs:
            for t in range(lo, hi):
                for f in mail.emit[t]:
                    out["l" + f, part] = out.get(("l" + f, part), 0) + 1
            for f in mail.whole(lo, hi, PARTS[part]):
                out["r" + f, part] = out.get(("r" + f, part), 0) + 1
        return out

    def learn(self, mail: Mail, gold: list[tuple[int, int, int]]) -> bool:
        """One averaged large-margin step towards the true segmentation."""
        self.steps += 1
        told = self.decode(mail)
        if told == gold:
            return False
        change: dict[tuple[str, int], int] = dict(self._features(mail, gold))
        for k, v in self._features(mail, told).items():
            change[k] = change.get(k, 0) - v
        for (f, part), v in change.items():
            if v:
                if f not in self.w:
                    self.w[f], self.sum[f] = np.zeros(len(PARTS)), np.zeros(len(PARTS))
                self.w[f][part] += v
                self.sum[f][part] += v * self.steps
        for runs, v in ((gold, 1), (told, -1)):
            before = -1
            for _, _, part in runs:
                self.move[before, part] += v
                self.move_sum[before, part] += v * self.steps
                before = part
        return True

    def averaged(self) -> SemiMarkov:
        for f in self.w:
            self.w[f] = self.w[f] - self.sum[f] / (self.steps + 1)
        self.move = self.move - self.move_sum / (self.steps + 1)
        self.sum = {}
        return self


_ZERO = np.zeros(len(PARTS))
_EACH = np.arange(len(PARTS))
_IS_S = np.array([p == "S" for p in PARTS], float)
_IS_Q = np.array([p == "Q" for p in PARTS], float)


def _gold(parts: list[str]) -> list[tuple[int, int, int]]:
    out, lo = [], 0
    for t in range(1, len(parts) + 1):
        if t == len(parts) or parts[t] != parts[lo] or t - lo == LONGEST:
            out.append((lo, t, PARTS.index(parts[lo])))
            lo = t
    return out


def practice(posts: int = POSTS, seed: int = 23) -> list[tuple[Mail, list[tuple[int, int, int]]]]:
    writer, out = Writer(seed), []
    for _ in range(posts):
        made = [(unmarked(line)[0], part) for line, part in writer.post()]
        mail = Mail("\n".join(line for line, _ in made))
        out.append((mail, _gold([part for line, part in made if line.strip()])))
    return out


def train(posts: int = POSTS, rounds: int = 4) -> SemiMarkov:
    model, table = SemiMarkov(), practice(posts)
    rng = np.random.default_rng(6)
    for _ in range(rounds):
        for i in rng.permutation(len(table)):
            model.learn(*table[i])
    return model.averaged()


def parts(model: SemiMarkov, text: str) -> list[tuple[int, str]]:
    """(line number from 1, part) of every non-blank line."""
    mail = Mail(text)
    return [(mail.number[t] + 1, PARTS[part]) for lo, hi, part in model.decode(mail) for t in range(lo, hi)]


def authored(posts: DataFrame, model: SemiMarkov, post_id: str = "post_id", text: str = "text") -> DataFrame:
    """(post_id, line_no, line): the lines that each sender newly wrote.

    Null texts and ids: no row; a text without line breaks is one line. Repeated deliveries repeat
    their rows. Texts are read whole; ties go to the part listed first. No shuffle.
    """
    shared = posts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = lines_of(body)
                for number, part in parts(model, body):
                    if part == "A":
                        out[0].append(i)
                        out[1].append(number)
                        out[2].append(every[number - 1])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["post_id", "line_no", "line"])

    source = posts.select(F.col(post_id).cast("bigint").alias("post_id"), F.col(text).alias("text")).where("post_id is not null and text is not null")
    return source.mapInArrow(run, "post_id bigint, line_no int, line string")


def new_text(posts: DataFrame, model: SemiMarkov) -> DataFrame:
    """(post_id, text): each mail reduced to its newly written lines."""
    lines = authored(posts.dropDuplicates(["post_id", "text"]), model).groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return lines.select("post_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))
