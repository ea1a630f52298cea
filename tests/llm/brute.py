"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    n_repeat = len(inside)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat, len(w) < 20 or 100 * n_repeat > 30 * len(w)


def secrets(text):
    found = []
    for k, (kind, pattern, least) in enumerate((("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[2] if k == 0 else m[0]) >= least]
    return [f[2] for f in sorted(found)]


def substrings(docs):
    held = [(d, words(t)) for d, t in docs]
    first = {}
    for d, w in held:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in held:
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(docs, radius=2):
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(docs, group, strict=True):
        if d is not None or g not in least:
            least[g] = d if least.get(g) is None else min(d, least[g])
    return prints, group, least


def simhash(docs, radius=2):
    prints, group, least = groups(docs, radius)
    return [(d, f"{p:016x}", least[g]) for (d, _), p, g in zip(docs, prints, group, strict=True)]


def near_groups(docs, similarity=0.8):
    """Groups of texts of whose sets of five-word shingles the smaller has at least this share in the other, and of the other's number,
    directly or through others."""
    sets = []
    for _, t in docs:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both, (few, many) = len(sets[i] & sets[j]), sorted((len(sets[i]), len(sets[j])))
            if both >= similarity * few and few >= similarity * many:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    spots = sorted((i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(spots), spots[0][0] if spots else None, spots[-1][0] if spots else None, ",".join(sorted({x for _, x in spots}))


def base_scores(docs):
    tokens = lambda t: [*words(lower(t)), ""]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = Counter(x for d, t in docs if not out(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, out(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for d, t in docs]


def judge_url(url):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent % $ usd eur dollar dollars euro euros cent cents mph kph km/h degree degrees celsius fahrenheit watt watts volt volts".split()
SPELLED = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()


def template(text):
    """Tokens (kind, value, first word, end word) of a text, and its plain words."""
    plain, tokens, stop, was = [], [], True, None
    for line in (text or "").split("\n"):
        stop = True
        for word in words(line):
            core = word.strip("!\"'()*,-./:;<>?[]_`{|}~#&") or word
            low = core.lower()
            if re.fullmatch(r"[0-9.,:/+$%-]*[0-9][0-9.,:/+$%-]*", core):
                kind = "digits"
            elif low in SPELLED:
                kind = "spelled"
            elif low in UNITS:
                kind = "unit"
            elif len(core.encode()) > 1 and core[0] != core[0].lower() and not re.search("[A-Z]", core[1:]):
                kind = "name"
            else:
                kind = "word"
            i = len(plain)
            joined = not stop and tokens and ((kind, was) in (("name", "name"), ("spelled", "spelled"), ("unit", "digits"), ("unit", "spelled")))
            if joined:
                tokens[-1][1] += " " + low
                tokens[-1][3] = i + 1
            else:
                tokens.append([{"digits": "number", "spelled": "number"}.get(kind, kind), low, i, i + 1])
            plain.append(low)
            was = kind
            stop = word[-1] in ".!?:|" or (word[-1] in "\"')]" and word[-2:-1] in tuple(".!?:|"))
    return plain, tokens


def passages(text, item):
    """Places of an item in a text: first word, end word, first word in the item, words found, slots that differ."""
    (plain, tokens), (item_plain, item_tokens) = template(text), template(item)
    size = len(item_plain)
    if size < 5:
        return []
    found = []
    for kind in ("plain", "template"):
        a = [("word", w, i, i + 1) for i, w in enumerate(plain)] if kind == "plain" else tokens
        b = [("word", w, i, i + 1) for i, w in enumerate(item_plain)] if kind == "plain" else item_tokens
        n = min(8, len(b))
        same = lambda x, y: x[0] == y[0] and (x[0] != "word" or x[1] == y[1])
        for shift in range(-len(b), len(a)):
            spots = []
            for j in range(len(b) - n + 1):
                literal = sum(t[0] == "word" for t in b[j : j + n])
                if kind == "template" and (literal < min(4, n) or literal == n):
                    continue
                if 0 <= shift + j and shift + j + n <= len(a) and all(same(a[shift + j + o], b[j + o]) for o in range(n)):
                    spots.append(j)
            while spots:
                run = [spots.pop(0)]
                while spots and spots[0] <= run[-1] + n:
                    run.append(spots.pop(0))
                inside = sorted({j + o for j in run for o in range(n)})
                pairs = {(b[j][0], b[j][1], a[shift + j][1]) for j in inside if b[j][0] != "word"}
                if one_to_one(pairs):
                    last = run[-1] + n - 1
                    found.append((a[shift + run[0]][2], a[shift + last][3], b[run[0]][2], b[last][3], pairs))
    found.sort(key=lambda f: f[:3])
    groups = []
    for f in found:
        if groups and f[0] <= max(x[1] for x in groups[-1]) + size:
            groups[-1].append(f)
        else:
            groups.append([f])
    out = []
    for g in groups:
        pairs, spots, taken = set(), set(), []
        for f in sorted(g, key=lambda f: (f[2] - f[3], f[0], f[2])):
            if one_to_one(pairs | f[4]):
                pairs |= f[4]
                spots |= set(range(f[2], f[3]))
                taken.append(f)
        if len(spots) >= min(size, 13) or 2 * len(spots) >= size:
            out.append((min(f[0] for f in taken), max(f[1] for f in taken), min(spots), len(spots), sum(a != b for _, a, b in pairs)))
    return out


def one_to_one(pairs):
    return len({p[:2] for p in pairs}) == len(pairs) == len({(p[0], p[2]) for p in pairs})
