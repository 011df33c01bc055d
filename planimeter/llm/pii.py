"""Personal data by a semi-Markov conditional random field over candidate segments.

Fixed patterns give base spans that always stay. Around anchors (an at sign, a digit) a text has short
zones of tokens; only these are decoded, as a token outside every zone cannot belong to an entity. In a zone
each segment of up to MAX_CHARS characters is scored as a whole for each type from features of the whole
span (its shape, digits, check digit, separators, the words before it), and a dynamic program over
segment ends chooses boundaries and types jointly. Weights maximise the conditional likelihood of
generated sentences of known spans (a fixed seed: the same weights everywhere), with exact gradients by
the forward and backward recursions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimeter.llm.common import small_batches, trim

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
# Of the e-mail pattern the part from the at sign on; its local part is found backwards, which is linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Words that announce an entity, by kind, in the training languages.
CUES = {
    "secret": {"token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "api-key", "bearer", "credential"},
    "email": {"email", "mail", "e-mail", "contact", "correo", "courriel"},
    "ip": {"ip", "host", "address", "server"},
    "card": {"card", "visa", "mastercard", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono"},
}

#: What the field finds beside the base kinds: values of passwords, keys and tokens.
TYPES = ("none", *KINDS, "secret")
#: Characters of a segment; a zone reaches as far from its anchors where no white space bounds it.
MAX_CHARS = 80
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\s+|\w")
DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]|\((?:at|AT)\)|\[(?:at|AT)\]|(?<=[dnty])[ \"']{0,2}[:=](?=[ \"']{0,2}[\w])", re.IGNORECASE)
#: A value that could be a secret: a run without white space or quotes.
VALUE = re.compile(r"[A-Za-z0-9_+/.~!$%^&*-]{8,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in the order of KINDS, then start; offsets are code points, ends exclusive."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# The field -----------------------------------------------------------------------------------------


def _features(kind: str, span: str, before: str, after: str) -> list[str]:
    """Names of the features of a whole candidate span of a kind."""
    if kind == "none":
        return ["none"]
    if kind == "secret":
        return _secret_features(span, before, after)
    d = _digits(span)
    shape = "".join(dict.fromkeys("d" if "0" <= c <= "9" else "a" if c.isalpha() else "s" if c.isspace() else c for c in span))
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", before.lower())
    names = [
        f"{kind}:bias",
        f"{kind}:shape={shape if len(shape) < 6 else 'long'}",
        f"{kind}:digits={min(len(d), 20)}",
        f"{kind}:cue={bool(words and CUES[kind] & set(words[-2:]))}",
        f"{kind}:edge={(before[-1:] or ' ').isspace() or before[-1:] in '(:,;<'}{not (after[:1].isalnum() or after[:1] in '@-+')}",
        f"{kind}:ends={span[:1].isalnum() or span[:1] in '+('}{span[-1:].isalnum()}",
    ]
    if kind == "card":
        names.append(f"card:luhn={13 <= len(d) <= 19 and luhn(d)}")
        names.append(f"card:groups={[len(x) for x in re.findall('[0-9]+', span)] in ([4, 4, 4, 4], [4, 6, 5], [16])}")
    elif kind == "email":
        names.append(f"email:form={bool(re.fullmatch(r'[\w.+-]+ ?[\[(]?(?:@|at|AT)[\])]? ?[\w-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[\w-]+)+', span))}")
    elif kind == "ip":
        names.append(f"ip:form={bool(re.fullmatch(r'(?:[0-9]{1,3}[.:]){3}[0-9]{1,3}', span)) and all(int(x) < 256 for x in re.findall('[0-9]+', span))}")
    else:
        names.append(f"phone:form={bool(re.fullmatch(r'(?:\+|00)?[0-9(][0-9() .-]+[0-9]', span)) and 9 <= len(d) <= 15}")
        names.append(f"phone:start={'+' if span[:1] == '+' else '00' if span[:2] == '00' else '(' if span[:1] == '(' else '-'}")
    return names


def _secret_features(span: str, before: str, after: str) -> list[str]:
    words = re.findall(r"[a-z]+(?:[_-][a-z]+)*", before.lower())
    lead = before.rstrip(" \"'")[-1:]
    kinds = sum(any(test(c) for c in span) for test in (str.isdigit, str.islower, str.isupper))
    hexadecimal = bool(re.fullmatch(r"[0-9a-fA-F]+", span))
    return [
        "secret:bias",
        f"secret:cue={bool(words and (words[-1] in CUES['secret'] or any(w in CUES['secret'] for w in re.split('[_-]', words[-1]))))}",
        f"secret:assigned={lead in ('=', ':')}",
        f"secret:quoted={before[-1:] in ('\"', chr(39)) and after[:1] == before[-1:]}",
        f"secret:size={min(len(span) // 8, 5)}",
        f"secret:kinds={kinds}{any('0' <= c <= '9' for c in span)}{hexadecimal}",
    ]


def _candidates(tokens: list[tuple[str, int, int]], text: str) -> list[tuple[int, int, str]]:
    """Segments (first token, end token, type): single tokens as none, spans that could be an entity."""
    out = []
    for i, (t, a, _) in enumerate(tokens):
        out.append((i, i + 1, "none"))
        if t.isspace():
            continue
        if (i == 0 or not VALUE.fullmatch(tokens[i - 1][0] * 8)) and (m := VALUE.match(text, a)) and m.end() - a <= MAX_CHARS:
            stop = m.end() - (text[m.end() - 1] in ".!")  # the end of a sentence
            j = next((j for j in range(i, len(tokens)) if tokens[j][2] >= stop), None)
            if j is not None and tokens[j][2] == stop and stop - a >= 8:
                out.append((i, j + 1, "secret"))
        has_digit = has_at = False
        for j in range(i, len(tokens)):
            t2, _, b = tokens[j]
            if "\n" in t2 or b - a > MAX_CHARS:
                break
            has_digit |= "0" <= t2[0] <= "9"
            has_at |= t2 in "@" or t2 in ("at", "AT")
            if t2.isspace():
                continue
            n = b - a
            if has_at and n >= 6:
                out.append((i, j + 1, "email"))
            if has_digit and t[0] in "0123456789+(" and "0" <= t2[0] <= "9":
                span = text[a:b]
                if any(c.isalpha() for c in span):
                    break
                d = len(_digits(span))
                if 4 <= d <= 12 and n <= 15 and (span.count(".") == 3 or span.count(":") == 3):
                    out.append((i, j + 1, "ip"))
                if 12 <= d <= 20:
                    out.append((i, j + 1, "card"))
                if 7 <= d <= 16:
                    out.append((i, j + 1, "phone"))
    return out


def _zone(text: str, first: int, last: int) -> tuple[int, int]:
    """The zone of the anchors from first to last (the end of the last): some room on both sides, cut at white
    space; where the room has none, as far as a segment can reach, or to white space on the way."""
    a, b = max(0, first - 40), min(len(text), last + 40)
    start = a
    while start > 0 and start < first and not text[start - 1].isspace():
        start += 1
    if start == first and start > 0 and not text[start - 1].isspace():
        start = a
        while start > max(0, first - MAX_CHARS) and not text[start - 1].isspace():
            start -= 1
    while b < min(len(text), last + MAX_CHARS) and not text[b].isspace():
        b += 1
    return start, b


def _zones(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of a text that hold its anchors, with room for cue words; ranges do not touch."""
    start = end = first = last = -1
    for m in ANCHOR.finditer(text):
        if first >= 0 and m.start() - 40 <= last + 40:
            last = m.end()
            continue
        if first >= 0:
            a, b = _zone(text, first, last)
            if end < 0:
                start, end = a, b
            elif a <= end:
                end = max(end, b)
            else:
                yield start, end
                start, end = a, b
        first, last = m.start(), m.end()
    if first >= 0:
        a, b = _zone(text, first, last)
        if end >= 0 and a > end:
            yield start, end
        yield (start, b) if 0 <= end and a <= end else (a, b)


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), *m.span()) for m in TOKEN.finditer(text)]


# Training sentences: generated by rule from these fixed shapes ---------------------------------------


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("er", "th", "on", "an", "ti", "le", "re", "st", "ou")) for _ in range(rng.randint(1, 4)))

    def card(ok: bool) -> str:
        while True:
            x = d(16)
            if luhn(x) == ok:
                return rng.choice((x, "-".join((x[:4], x[4:8], x[8:12], x[12:])), " ".join((x[:4], x[4:8], x[8:12], x[12:]))))

    def entity(kind: str) -> str:
        if kind == "email":
            at = rng.choice(("@", "@", "@", " (at) ", "[at]"))
            return f"{word()}.{d(2)}{at}{word()}.{rng.choice(('com', 'org', 'net', 'example.com'))}"
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return card(True)
        if kind == "secret":
            pool = rng.choice(("0123456789abcdef", "0123456789ABCDEF", "abcdefghijkmnopqrstuvwxyz0123456789ABCDEFGHJKLMNPQRSTUVWXYZ", "abcdefghkmnp23456789!$%_-"))
            return rng.choice("abcdefABCDEF"[: 6 if pool[-1] != "F" else 12]) + "".join(rng.choice(pool) for _ in range(rng.choice((9, 15, 19, 31, 39, 63))))
        return rng.choice((f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"00{d(2)} {d(3)} {d(6)}", f"({d(3)}) {d(3)}-{d(4)}"))

    other = (
        lambda: d(rng.randint(1, 6)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(2)}.{d(2)}%",
        lambda: card(False), lambda: d(20), lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: f"{d(4)}.{d(3)}.{d(4)}.{d(3)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((12, 32, 40)))), lambda: f"{word()} = {d(8)}", lambda: f"{word()}: {word()}{word()}{word()}", lambda: f"version {d(1)}.0", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{d(3)},{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{word()} {d(10)}", lambda: f"{d(5)} {d(5)} {d(3)}",
    )
    parts, spans, n = [], [], 0
    for _ in range(rng.randint(2, 5)):
        chosen = rng.choice(("word", "word", "other", "other", *TYPES[1:]))
        if chosen == "word":
            x = word()
        elif chosen == "other":
            x = rng.choice(other)()
        elif chosen == "secret":
            name = rng.choice(sorted(CUES["secret"]))
            name = rng.choice((name, name, name.upper(), f"{word()}_{name}"))
            quote = rng.choice(("", "", '"', "'"))
            lead, x = name + rng.choice(("=", " = ", ": ", ":")) + quote, entity("secret")
            parts.append(lead)
            n += len(lead)
            spans.append((n, n + len(x), "secret"))
            x += quote
        else:
            x = entity(chosen)
            # A bare local number is personal only where a cue announces it.
            cue = rng.random() < 0.5 or x[0] == "(" or x[:2] == "00"
            if cue:
                c = rng.choice(sorted(CUES[chosen])) + rng.choice((" ", ": "))
                parts.append(c)
                n += len(c)
            spans.append((n, n + len(x), chosen))
        parts.append(x + rng.choice((" ", " ", ". ", ", ")))
        n += len(parts[-1])
    return "".join(parts), spans


def _lattice(text: str, a: int, b: int, lookup) -> tuple[list, list[tuple[int, int, str]], list[list[int]]]:
    tokens = [(t, x + a, y + a) for t, x, y in _tokens(text[a:b])]
    segments = _candidates(tokens, text)
    # A zone cut inside a word shows that there is no white space before it.
    floor = a - (a > 0 and not text[a - 1].isspace())
    feats = []
    for i, j, kind in segments:
        if kind == "none":
            names = ["none"]
        else:
            x, y = tokens[i][1], tokens[j - 1][2]
            names = _features(kind, text[x:y], text[max(floor, x - 24) : x], text[y : y + 1])
        feats.append([k for n in names if (k := lookup(n)) is not None])
    return tokens, segments, feats


@lru_cache(1)
def weights(sentences: int = 500, rounds: int = 8, seed: int = 9) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood of generated sentences."""
    rng = random.Random(seed)
    index: dict[str, int] = {}
    lookup = lambda n: index.setdefault(n, len(index))
    data = []
    for _ in range(sentences):
        text, spans = _sentence(rng)
        tokens, segments, feats = _lattice(text, 0, len(text), lookup)
        gold = {(a, b, k) for a, b, k in spans}
        used = [False] * len(tokens)
        right = []
        for s, (i, j, kind) in enumerate(segments):
            if kind != "none" and (tokens[i][1], tokens[j - 1][2], kind) in gold:
                right.append(s)
                used[i:j] = [True] * (j - i)
        right += [s for s, (i, j, kind) in enumerate(segments) if kind == "none" and not used[i]]
        data.append((len(tokens), segments, feats, right))
    w = np.zeros(len(index))
    for step in range(rounds):
        rate = 0.3 / (1 + step)
        for n, segments, feats, right in data:
            score = [float(w[f].sum()) for f in feats]
            alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
            alpha[0] = beta[n] = 0.0
            for s, (i, j, _) in sorted(enumerate(segments), key=lambda x: x[1][0]):
                alpha[j] = float(np.logaddexp(alpha[j], alpha[i] + score[s]))
            for s, (i, j, _) in sorted(enumerate(segments), key=lambda x: -x[1][0]):
                beta[i] = float(np.logaddexp(beta[i], beta[j] + score[s]))
            for s in right:
                w[feats[s]] += rate
            for s, (i, j, _) in enumerate(segments):
                p = math.exp(alpha[i] + score[s] + beta[j] - alpha[n])
                if p > 1e-6:
                    np.subtract.at(w, feats[s], rate * p)
        w *= 0.999
    return {n: float(w[i]) for n, i in index.items()}


def field_spans(text: str, w: dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans of the best segmentation of each zone of a text."""
    out = []
    for a, b in _zones(text):
        tokens, segments, feats = _lattice(text, a, b, lambda n: n)
        n = len(tokens)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for (i, j, kind), f in sorted(zip(segments, feats, strict=True), key=lambda x: x[0][0]):
            s = best[i] + sum(w.get(name, -0.5) for name in f)
            if s > best[j]:
                best[j], back[j] = s, (i, kind)
        j = n
        while j:
            i, kind = back[j]
            if kind != "none":
                out.append((kind, tokens[i][1], tokens[j - 1][2]))
            j = i
    return out


def find_spans(text: str, w: dict[str, float]) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and those of the field that touch no base span."""
    base = base_spans(text)
    if not ANCHOR.search(text):
        return base, base
    held = sorted((a, b) for _, a, b in base)
    more = [s for s in field_spans(text, w) if not any(a < s[2] and s[1] < b for a, b in held)]
    every = sorted(dict.fromkeys(base + more), key=lambda s: (TYPES.index(s[0]), s[1]))
    return base, every


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (merged where they overlap) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(w: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, found = [], [], [], []
            for t in batch.column(1):
                base, every = find_spans(t.as_py() or "", w)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(every))
                found.append((sum(k == "secret" for k, _, _ in every), len(every)))
            columns = {"doc_id": batch.column(0)}
            columns |= {f"n_{k}": pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(KINDS)}
            columns |= {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())}
            yield pa.record_batch(columns | {n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("n_secret", "n_spans"))})

    return run


def pii_spans(df: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_secret and n_spans (all).

    A null or empty text has no spans. Keys may be null or repeat: each row is scanned by itself. Spans
    of one kind never repeat; ties in score keep the shorter reading of what comes first. An empty table
    gives no rows; other columns are not read."""
    small_batches(df.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(weights()), schema)


def redacted(df: DataFrame, *, text_col="text", chars_col="n_chars") -> DataFrame:
    """df with every span in its text replaced by <kind>, and chars_col (if there) set to the new length.

    Null texts stay null, and so does their length."""
    w = weights()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            kind = batch.schema.field(i)
            clean = [None if (t := x.as_py()) is None else redact(t, find_spans(t, w)[1]) for x in batch.column(i)]
            batch = batch.set_column(i, kind, pa.array(clean, kind.type))
            k = batch.schema.get_field_index(chars_col)
            if k >= 0:
                kind = batch.schema.field(k)
                batch = batch.set_column(k, kind, pa.array([None if t is None else len(t) for t in clean], kind.type))
            yield batch
            trim()

    return df.mapInArrow(run, df.schema)
