"""Plain versions of the operators, for small tables."""

import datetime
import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def decontamination(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = LETTERS.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(item))
    out = []
    for doc, text in docs:
        w = LETTERS.findall((text or "").translate(LOW))
        hit, met = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    met |= found
                    hit[k : k + n] = [True] * n
        out.append((doc, len(w), sum(hit), len(met), sha(",".join(sorted(met))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def kept_lines(docs):
    """[(doc_id, lines, dropped, text)]"""
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and text is not None and len(key(line)) >= 20:
                held[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or not (len(held.get(key(x), ())) >= 3 and doc != max(held[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingle_set(text):
    w = SPACES.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    sets = [(d, shingle_set(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            both = len(sa & sb)
            if both and 100 * both >= 75 * (len(sa) + len(sb) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


def repeats(docs, length=400):
    texts = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def edited(docs):
    """[(doc_id, characters, edited text)]"""
    order = sorted(((d, t or "") for d, t in docs if d is not None), key=lambda x: (-x[0], x[1]))
    out = []
    for k, (d, t) in enumerate(order):
        after, third = order[(k + 1) % len(order)][1], len(t) // 3
        out.append((d, len(t), t[: len(t) - third] + after[:third]))
    return out


def _prf(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts), key]).encode()).hexdigest()[:15], 16)


def permuted(a, size_a, b, size_b, key, tag):
    for r in range(8):
        if r % 2 == 0:
            a = (a + _prf(key, tag, r, b) % size_a) % size_a
        else:
            b = (b + _prf(key, tag, r, a) % size_b) % size_b
    return a, b


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))


def refilled(form, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in form)


def pseudonym(kind, x, key):
    """What a number or date becomes; None if it does not validate."""
    d = "".join(c for c in x if c.isdigit())
    if kind == "card":
        if luhn(d) % 10:
            return None
        n, half = len(d) - 1, (len(d) - 1) // 2
        a, b = permuted(int(d[:half]), 10**half, int(d[half:n]), 10 ** (n - half), key, "card")
        body = f"{a:0{half}d}{b:0{n - half}d}"
        return refilled(x, body + str(-luhn(body + "0") % 10))
    if kind == "ssn":
        area, group, serial = int(x[:3]), int(x[4:6]), int(x[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        a, b = permuted(area - 1 - (area > 666), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, "ssn")
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "phone":
        code, d = d[:-10], d[-10:]
        area, exchange = int(d[:3]), int(d[3:6])
        if not code and min(area, exchange) < 200:
            return None
        low = [0 if c < 200 else 200 for c in (area, exchange)]
        size = [800 if c else 200 for c in low]
        a, b = permuted(area - low[0], size[0], (exchange - low[1]) * 10000 + int(d[6:]), size[1] * 10000, key, "phone")
        return refilled(x, f"{code}{a + low[0]:03d}{b // 10000 + low[1]:03d}{b % 10000:04d}")
    if kind == "ip":
        o = [int(p) for p in x.split(".")]
        if max(o) > 255:
            return None
        a, b = permuted(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    first = datetime.date(1800, 1, 1)
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"):
        try:
            day = (datetime.datetime.strptime(x, form).date() - first).days
        except ValueError:
            continue
        if not 0 <= day < 189 * 773:
            return None
        a, b = permuted(day // 773, 189, day % 773, 773, key, "date")
        new = first + datetime.timedelta(a * 773 + b)
        return {"%Y-%m-%d": f"{new.year:04d}-{new.month:02d}-{new.day:02d}"}.get(form, form.replace("%d", f"{new.day:02d}").replace("%m", f"{new.month:02d}").replace("%Y", f"{new.year:04d}"))
    try:
        date = datetime.datetime.strptime(x, "%m/%d/%Y")
    except ValueError:
        return None
    if date.day < 13 or not 1800 <= date.year < 2200:
        return None
    a, b = (date.year - 1800) * 12 + date.month - 1, date.day - 13
    while True:
        a, b = permuted(a, 4800, b, 19, key, "month")
        try:
            return f"{datetime.date(1800 + a // 12, a % 12 + 1, b + 13):%m/%d}/{1800 + a // 12}"
        except ValueError:
            pass


def alignment(docs, left, right):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)]; left: the file of a byte-level BPE, right: of a SentencePiece model."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(left), sentencepiece.SentencePieceProcessor(model_file=right)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    out, held = [], Counter()
    for doc, text in docs:
        whole = f" {text or ''}".encode()
        ids_a = a.encode(f" {text or ''}", add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append([doc, 0, 0, 0, [], ""])
            continue
        spans_a, spans_b = [], []
        for spans, tokens in ((spans_a, bytes_a), (spans_b, bytes_b)):
            at = 0
            for t in tokens:
                spans.append((at, at := at + len(t)))
        links, k = [], 0
        for i, (lo, hi) in enumerate(spans_a):
            while spans_b[k][1] <= lo:
                k += 1
            m = k
            while m < len(spans_b) and spans_b[m][0] < hi:
                links.append((ids_a[i], ids_b[m]))
                m += 1
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        sides = []
        for ids, spans in ((ids_a, spans_a), (ids_b, spans_b)):
            group = [[]]
            for x, (_, hi) in zip(ids, spans, strict=True):
                group[-1].append(str(x))
                if hi == cuts[len(group) - 1]:
                    group.append([])
            sides.append([",".join(g) for g in group[:-1]])
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
        held.update(set(links))
        out.append([doc, len(ids_a), len(ids_b), len(cuts), links, sha(";".join(groups))])
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(doc, n_a, n_b, n, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest) for doc, n_a, n_b, n, links, digest in out]


def manifest(docs):
    """{(doc_id, leaf): (subroot, root, proof, folded, verified)} of (doc_id, source, lang, n_chars, text); rows of one doc_id and leaf are the same."""
    import zlib

    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda row: sha("".join(map(field, row)))

    def tree(level):
        """(root, the way of each leaf: digests before and after it on each level)"""
        ways = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            for way, k in zip(ways, at, strict=True):
                first = k // 16 * 16
                way.append((level[first:k], level[k + 1 : first + 16]))
            level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
            at = [k // 16 for k in at]
        return level[0], ways

    of = defaultdict(list)
    for row in docs:
        of[row[1]].append(row)
    names = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(of[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    trees = {x: tree([leaf(r) for r in ordered[x]]) for x in names}
    root, tops = tree([trees[x][0] for x in names])
    out = []
    for x, top in zip(names, tops, strict=True):
        for row, way in zip(ordered[x], trees[x][1], strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf((*row[:4], row[4].translate(LOW) if bad and row[4] is not None else row[4]))
            for before, after in way + top:
                folded = sha("".join([*before, folded, *after]))
            proof = sha("".join("".join(before + after) for before, after in way + top))
            out.append((row[0], leaf(row), trees[x][0], root, proof, folded, folded == root))
    return out


def jaccard_links(docs, percent=80, width=5):
    """[(doc_id, n_shingles, component_id, n_links)]"""
    own = []
    for _, text in docs:
        w = SPACES.findall((text or "").translate(LOW))
        own.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    ends = defaultdict(set)
    for i, a in enumerate(own):
        for j in range(i):
            if a and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & own[j]) >= percent * len(a | own[j]):
                ends[i].add(j)
                ends[j].add(i)
    out = []
    for i, (doc, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            new = ends[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((doc, len(own[i]), None if doc is None else min(docs[k][0] for k in seen), len(ends[i])))
    return out
