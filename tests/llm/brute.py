"""Plain Python forms of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONSPACE = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, items):
    windows = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        words = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        yield doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def op2(docs):
    for doc, text in docs:
        text = text or ""
        words = NONSPACE.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if NONSPACE.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(windows)
        repeat = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
        n = len(words)
        yield doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 10 or 100 * len(repeat) > 20 * n


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op5(docs):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    for doc, text in docs:
        spans = [(m.start(), no, kind, m.end()) for no, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m[0])]
        n = Counter(s[2] for s in spans)
        yield doc, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))


def op6(docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for doc, text in docs:
        words = ALNUM.findall(lower(text))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        yield doc, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def op7(docs):
    sets = []
    for _, text in docs:
        words = NONSPACE.findall(lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)]


def op8(docs):
    for doc, text in docs:
        yield doc, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())


def op10(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield doc, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def op4(docs, path):
    import struct

    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(path), 0
    for doc, text in sorted(docs, key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def op11(docs, items, k=50):
    from math import floor, log

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(doc, Counter(term.findall(lower(text)))) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    for item, text in items:
        own, scores = dict.fromkeys(term.findall(lower(text))), []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            yield item, rank, doc, -score


def op12(docs, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for doc, text in docs:
        whole = f" {text or ''}".encode()
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelled = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or any(b"".join(x) != whole for x in spelled):
            found.append((doc, [], [], [], []))
            continue
        spans = []
        for parts in spelled:
            at, own = 0, []
            for x in parts:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        sides = []
        for ids, own in zip((ids_a, ids_b), spans, strict=True):
            parts = [[]]
            for i, (_, e) in zip(ids, own, strict=True):
                parts[-1].append(str(i))
                if e == ends[len(parts) - 1]:
                    parts.append([])
            sides.append([",".join(x) for x in parts[:-1]])
        groups = [";".join(f"{x}|{y}" for x, y in zip(*sides, strict=True)), len(ends)]
        links, low = [], 0
        for x, (s, e) in zip(ids_a, spans[0], strict=True):
            while spans[1][low][1] <= s:
                low += 1
            at = low
            while at < len(ids_b) and spans[1][at][0] < e:
                links.append((x, ids_b[at]))
                at += 1
        count.update(set(links))
        found.append((doc, ids_a, ids_b, groups, links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    for doc, ids_a, ids_b, groups, links in found:
        n = [count[x] for x in links]
        yield doc, len(ids_a), len(ids_b), groups[1] if groups else 0, len(links), sum(c == best[x[0]] for c, x in zip(n, links, strict=True)), sum(n), sha(groups[0]) if groups else ""
