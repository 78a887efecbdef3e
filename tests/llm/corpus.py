"""A small fixed corpus with copies, near copies, passages, labels and odd rows."""

import random

WORDS = {
    "en": "the of and to in that it is was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
}
TOXIC = "idiot moron scum loser trash".split()


def sentence(rng, lang="en", n=None):
    w = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er", "ing", "ly"]) for _ in range(n or rng.randint(5, 14))]
    return " ".join(w).capitalize() + "."


def prose(rng, lang="en", sentences=12):
    return " ".join(sentence(rng, lang) for _ in range(sentences))


def documents(n=120, seed=7):
    """Rows (doc_id, text, lang, source, n_chars) and labels (doc_id, toxic)."""
    rng = random.Random(seed)
    rows, toxic = [], {}
    passage = " ".join(sentence(rng, "en", 12) for _ in range(6))
    for i in range(n):
        lang = "de" if i % 5 == 0 else "en"
        text = prose(rng, lang, rng.randint(6, 20))
        if i % 11 == 3:
            text += "\n" + passage + "\n" + sentence(rng, lang)
        if i % 6 == 1:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
            text, toxic[i] = " ".join(w), 1
        else:
            toxic[i] = 0
        rows.append([i, text, lang, "src0" if i % 3 == 0 else f"src{i % 7}"])
    for k in range(20):  # exact copies and copies with few edits
        base = rows[k * 2]
        w = base[1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "edited"
        rows.append([n + k, " ".join(w) if k % 4 else base[1], base[2], base[3]])
        toxic[n + k] = toxic[base[0]]
    rows += [[n + 20, None, None, None], [n + 21, "", "en", "src1"], [n + 22, " \t\n ", "en", "src1"], [n + 23, "One.", "en", None], [n + 24, prose(rng, "en", 4000), "en", "src2"], [n + 25, "x" * 50_000, None, "src2"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], list(toxic.items())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside.
CLASHES = ("n", "sid", "key", "keys", "score", "tokens", "g", "weight", "topic", "raw", "shard", "h", "spans", "_text", "_d", "_gone", "_source", "_share", "__topic")
