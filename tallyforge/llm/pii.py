"""Personal data: exact rules for four kinds, and a linear-chain conditional random field that adds spans."""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import chunks, text_rows, without

KINDS = ("email", "ip", "card", "phone")
#: An address, or a run of its first part's characters that begins none, so that a long run is read once.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Tokens that may belong to personal data of these kinds hold a digit, an @ or a spelled-out one.
MARKED = re.compile(r"[0-9@]\S*")
SPELLED = re.compile(r"[(\[]\s*(?:at|dot)\s*[)\]]", re.I)
#: Tokens; a spelled-out sign is in one, with the spaces within its brackets.
WHOLE = re.compile(rf"(?:{SPELLED.pattern}|\S)+", re.I)
TOKEN = re.compile(r"\S+")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DIM = 1 << 12
#: A card's number has so many digits at least; shorter runs of groups that look like one are phones.
CARD_DIGITS = 13
OUT = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    """At most 255, whatever its length."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the exact rules, in order of kind, then start; failing matches are dropped, not retried."""
    found = []
    if "@" in text:
        found += [(0, m.start(), m.end()) for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return found


# ------------------------------------------------------------------ the random field


def labelled_table(rows: int = 400, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences of (token, label), made by rule from invented names and numbers."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["the", "an", "er", "on", "re", "la", "ich", "que", "ion", "st"]) for _ in range(rng.randint(1, 4)))
    host = lambda: f"{word()}{rng.choice(['', digits(1)])}"
    octet = lambda: str(rng.randint(0, 255))

    def email():
        name = word() + rng.choice(["", ".", "_"]) + rng.choice([word(), digits(2)])
        return rng.choice(
            [
                [f"{name}@{host()}.example.com"],
                [f"{name}@{host()}.{rng.choice(['org', 'net', 'com'])}"],
                [name, rng.choice(["(at)", "[at]"]), host(), rng.choice(["(dot)", "[dot]"]), "com"],
                [f"{name}(at){host()}.com"],
                [f"{name}@{host()}"],
            ]
        )

    def phone():
        return rng.choice(
            [
                [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
                [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
                [f"{digits(3)}-{digits(3)}-{digits(4)}"],
                [f"{digits(3)}.{digits(3)}.{digits(4)}"],
                [f"+{digits(2)}", digits(3), digits(6)],
            ]
        )

    def number(valid: bool) -> str:
        while luhn(n := digits(16)) != valid:
            pass
        return n

    def card():
        n = number(True)
        groups = [n[i : i + 4] for i in range(0, 16, 4)]
        return rng.choice([[n], groups, ["-".join(groups)], [".".join(groups)], ["/".join(groups)]])

    def ip():
        return [".".join(octet() for _ in range(4)) + rng.choice(["", "", ":" + digits(4)])]

    def clean():
        hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 40])))
        return rng.choice(
            [
                [f"password={hexed}"],
                [f'"{hexed}"'],
                ["AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))],
                ["Version", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}."],
                ["version", f"{rng.randint(1, 9)}."],
                ["BY-NC", "4.0."],
                [str(rng.randint(1900, 2099))],
                [f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}"],
                [f"{rng.randint(1990, 2030)}-{digits(2)}-{digits(2)}"],
                [digits(rng.randint(1, 9))],
                [digits(rng.randint(1, 3)) + word()],
                [word() + digits(rng.randint(1, 3))],
                [f"{digits(2)}:{digits(2)}"],
                [digits(rng.randint(20, 30))],
                [number(False)],
                [word() + rng.choice(["%%%", "###", "&&&", "***", "$$$", "!!"]) for _ in range(3)] + [digits(2)],
                ["|", word(), "|", digits(2)],
            ]
        )

    makers = {"email": email, "phone": phone, "card": card, "ip": ip}
    out = []
    for i in range(rows):
        sentence = [(word(), "O") for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice([*KINDS, None, None, None])
            tokens = makers[kind]() if kind else clean()
            if rng.random() < 0.2 and tokens:
                tokens[-1] += rng.choice(".,;")
            sentence += [(t, "O" if not kind else f"{'I' if j else 'B'}-{kind}") for j, t in enumerate(tokens)]
            sentence += [(word(), "O") for _ in range(rng.randint(1, 3))]
        out.append(sentence)
    return out


def shape(token: str) -> tuple[str, ...]:
    """Word-shape features of a token; those of short ones are kept."""
    return short_shape(token) if len(token) <= 64 else token_shape(token)


def token_shape(token: str) -> tuple[str, ...]:
    core = token.strip(".,;:!?\"'")
    long = re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", core)))
    runs = re.sub(r"(.)\1+", r"\1", long)
    n = sum(c in "0123456789" for c in core)
    return (
        f"runs={runs}",
        f"long={long}" if len(long) <= 20 and not core.isalpha() else "long=word",
        f"digits={n if n < 20 else 20}",
        f"size={min(len(core), 20) if n else 'w'}",
        f"at={'@' in core}",
        f"low={core.lower()}" if core.lower().strip("()[]") in ("at", "dot", "version") else "low=-",
        f"luhn={n >= 16 and luhn(''.join(c for c in core if c in '0123456789'))}",
        f"hex={bool(re.fullmatch('[0-9a-f]{12,}', core)) and not core.isdigit()}",
    )


short_shape = lru_cache(100_000)(token_shape)


def feature_ids(tokens: list[str]) -> list[list[int]]:
    """Hashed features of each token: its own shape, and its neighbours'."""
    import zlib

    shapes = [shape(t) for t in tokens]
    out = []
    for i, own in enumerate(shapes):
        names = list(own)
        for j, tag in ((i - 1, "p"), (i + 1, "n")):
            names += [f"{tag}{x}" for x in (shapes[j][0], shapes[j][5])] if 0 <= j < len(shapes) else [f"{tag}end"]
        out.append([zlib.crc32(x.encode()) % DIM for x in names])
    return out


def train_crf(table=None, epochs: int = 25, rate: float = 0.4, l2: float = 1e-4):
    """Weights (features x labels) and transitions by gradient ascent on the conditional likelihood, row by row."""
    import numpy as np

    rows = [([t for t, _ in s], np.array([LABELS.index(y) for _, y in s])) for s in (table or labelled_table())]
    rows = [(feature_ids(t), y) for t, y in rows if t]
    n = len(LABELS)
    weights, moves = np.zeros((DIM, n)), np.zeros((n, n))
    seen_w, seen_m = np.full((DIM, n), 1e-3), np.full((n, n), 1e-3)
    order = np.arange(len(rows))
    rng = np.random.default_rng(5)
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for _ in range(epochs):
        for r in rng.permutation(order):
            ids, y = rows[r]
            emit = np.array([weights[i].sum(axis=0) for i in ids])
            size = len(y)
            alpha, beta = np.zeros((size, n)), np.zeros((size, n))
            alpha[0] = emit[0]
            for t in range(1, size):
                alpha[t] = emit[t] + lse(alpha[t - 1][:, None] + moves, 0)
            for t in range(size - 2, -1, -1):
                beta[t] = lse(moves + (emit[t + 1] + beta[t + 1])[None, :], 1)
            whole = lse(alpha[-1], 0)
            g_m = np.zeros((n, n))
            for t in range(size):
                p = np.exp(alpha[t] + beta[t] - whole)
                g = -p
                g[y[t]] += 1
                seen_w[ids[t]] += g**2
                weights[ids[t]] += rate * g / np.sqrt(seen_w[ids[t]]) - l2 * weights[ids[t]]
                if t:
                    g_m -= np.exp(alpha[t - 1][:, None] + moves + (emit[t] + beta[t])[None, :] - whole)
                    g_m[y[t - 1], y[t]] += 1
            seen_m += g_m**2
            moves += rate * g_m / np.sqrt(seen_m)
    for j, label in enumerate(LABELS):  # an inside label follows its own kind only
        if label[0] == "I":
            for i, before in enumerate(LABELS):
                if before not in (f"B-{label[2:]}", label):
                    moves[i, j] = -1e9
    return weights, moves


@lru_cache(1)
def trained_crf():
    """The model of the labelled table above, trained once a process (it depends on nothing else)."""
    return train_crf()


def viterbi(model, sequences: list[list[str]]) -> list[list[int]]:
    """Best labels of a batch of token sequences: one numpy step per place over all sequences that reach it."""
    import numpy as np

    weights, moves = model
    first = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    out: list[list[int]] = [[] for _ in sequences]
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        sizes = np.array([len(sequences[i]) for i in part])
        emits = [np.array([weights[f].sum(axis=0) for f in feature_ids(sequences[i])]) for i in part]
        score = np.array([e[0] for e in emits]) + first
        back = []
        for t in range(1, sizes[0] if len(sizes) else 0):
            n = int((sizes > t).sum())
            step = score[:n, :, None] + moves[None]
            best = step.argmax(axis=1)
            back.append(best)
            score[:n] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + np.array([e[t] for e in emits[:n]])
        for row, i in enumerate(part):
            label = int(score[row].argmax())
            path = [label]
            for t in range(int(sizes[row]) - 1, 0, -1):
                label = int(back[t - 1][row, label])
                path.append(label)
            out[i] = path[::-1]
    return out


def windows(text: str, around: int = 2) -> list[list[tuple[int, int]]]:
    """Token runs (start, end) to decode: tokens with a digit, @ or a spelled-out (at) or (dot), and ``around`` at either side.

    A run goes on as long as the next such token is near, so an address with many dots is in one run to its end.
    """
    spelled = SPELLED.search(text) is not None
    if not spelled and "@" not in text and not DIGIT.search(text):
        return []
    tokens = [m.span() for m in (WHOLE if spelled else TOKEN).finditer(text)]
    starts = [a for a, _ in tokens]
    marks = sorted({bisect_right(starts, m.start()) - 1 for p in ((MARKED, SPELLED) if spelled else (MARKED,)) for m in p.finditer(text)})
    runs: list[list[int]] = []
    for i in marks:
        low, high = max(0, i - around), min(len(tokens), i + around + 1)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    return [tokens[low:high] for low, high in runs]


def read(token: str) -> str:
    """The token as the random field sees it: spelled-out signs without spaces, in lower case."""
    return SPELLED.sub(lambda m: "".join(m[0].split()).lower(), token) if token[-1] in ")]" or "(" in token or "[" in token else token


def decoded_spans(model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the random field finds in each text."""
    runs = [(i, run) for i, text in enumerate(texts) for run in windows(text)]
    paths = viterbi(model, [[read(texts[i][a:b]) for a, b in run] for i, run in runs])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), path in zip(runs, paths, strict=True):
        open_at = None
        for t, label in enumerate([*path, 0]):
            name = LABELS[label]
            if open_at is not None and not (name[0] == "I"):
                kind, begin = open_at
                start, end = run[begin][0], run[t - 1][1]
                core = texts[i][start:end]
                start, end = start + len(core) - len(core.lstrip("\"'<,;")), end - len(core) + len(core.rstrip(".,;:!?\"'>"))
                if KINDS[kind] == "card" and (digits := sum(c.isdigit() for c in texts[i][start:end])) < CARD_DIGITS:
                    kind = KINDS.index("phone") if digits >= 8 else None  # no card is so short
                if kind is not None and start < end:
                    found[i].append((kind, start, end))
                open_at = None
            if name[0] == "B":
                open_at = (KINDS.index(name[2:]), t)
    return found


def merged(base: list, more: list) -> list:
    """Base spans with those of ``more`` that overlap none of them, sorted; each once."""
    starts = sorted((s, e) for _, s, e in base)
    reach = list(accumulate((e for _, e in starts), max))  # how far the spans up to each one go
    added = [x for x in more if not (i := bisect_left(starts, (x[2],))) or reach[i - 1] <= x[1]]
    return sorted({*base, *added})


def all_spans(model, texts: list[str]) -> list[tuple[list, list]]:
    """Of each text its base spans, and those with the spans that the random field adds where no base span lies."""
    out = []
    for text, more in zip(texts, decoded_spans(model, texts), strict=True):
        base = base_spans(text)
        out.append((base, merged(base, more)))
    return out


def joined_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, upto = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        if start >= upto:
            out += [text[upto:start], f"<{KINDS[kind].upper()}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def finder(model, at: int, n: int, redact: bool):
    """A mapInArrow function: the first ``n`` columns, and what is found in the text in column ``at``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in chunks(batch.column(at), 250_000):
                part = batch.slice(start, stop - start)
                given = part.column(at).to_pylist()
                found = all_spans(model.value, [t or "" for t in given])
                counts = [pa.array([sum(k == j for k, *_ in base) for base, _ in found], pa.int64()) for j in range(4)]
                lists = [pa.array([joined_spans(x[c]) for x in found], pa.string()) for c in (0, 1)]
                columns, names = [*part.columns[:n], *counts, *lists], [*part.schema.names[:n], *OUT]
                if redact:
                    new = (None if t is None else redacted(t, spans) for t, (_, spans) in zip(given, found, strict=True))
                    columns.append(pa.array(new, pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def find_personal_data(spark: SparkSession, docs: DataFrame, *, redact: bool = False, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with counts per kind and spans (kind:start:end, code points, end exclusive) of every whole text.

    base_spans are those of the exact rules; spans adds those of the random field, which overlap no base span. With
    ``redact`` a column ``redacted`` has the text with its spans replaced. The field is trained from a small labelled
    table on the driver, in seconds, and broadcast (its size is fixed by ``DIM``). A null text counts as empty (its
    redaction is null). Rows are independent, so ties, repeated rows and empty tables need no care. Input columns named
    like an output column are replaced. ``keep`` names the columns to return besides (default: all).
    """
    docs = without(docs, [*OUT, *(["redacted"] if redact else [])])
    names = docs.columns if keep is None else keep
    model = spark.sparkContext.broadcast(trained_crf())
    rows, at, schema = text_rows(docs, names, text_col)
    schema += "".join([*(f", {c} long" for c in OUT[:4]), ", base_spans string, spans string", ", redacted string" * redact])
    return rows.mapInArrow(finder(model, at, len(names), redact), schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(spark, docs, keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
