"""Surrogates: narrow formats, names, and all kinds against an independent reading."""

import random
import re

import regex

from edge import docs
from gridlore.llm import pii


def test_formats_with_too_few_surrogates(spark):
    real = [f"+{n}" for n in range(2010, 2020)] + [f"+123 {n}" for n in range(10, 80)]
    secrets = ["------------", "-----------1", "____________"]
    texts = [f"call {p} now" for p in real] + [f"a key: {s} here" for s in secrets]
    got = {r["doc_id"]: r for r in pii.replace(docs(spark, [(i, t, "", "a") for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts) and all(r["n_entities"] == 1 for r in got.values())
    phones = [re.fullmatch(r"call (\+[\d ]+) now", got[i]["text"])[1] for i in range(len(real))]
    keys = [re.fullmatch(r"a key: (\S+) here", got[len(real) + i]["text"])[1] for i in range(len(secrets))]
    assert len(set(phones)) == len(real) and not set(phones) & set(real)
    assert len(set(keys)) == len(secrets) and not set(keys) & set(secrets)
    assert all(re.fullmatch(pii.PHONE, p) for p in phones)


def test_keywords_of_any_case_and_more_formats(spark):
    held = ["PASSWORD=Abcdefgh1234", "API_KEY: abcd1234efgh5678", 'Token = "abcd1234efgh5678"', "743-555-3824", "743.555.3825", "2001:db8::8a2e:370:7334", "FE80:0:0:0:202:B3FF:FE1E:8329"]
    plain = ["a[1::2]", "std::vector", "12:30:45", "978-0-306-40615-7", "1.2.3", "x :: Int"]
    rows = [(i, f"see {t} there", "", "a") for i, t in enumerate(held + plain)]
    got = {r["doc_id"]: r for r in pii.replace(docs(spark, rows)).collect()}
    for i, t in enumerate(held):
        secret = re.split(r"[=:] ?\"?(?=[A-Za-z])", t)[-1].strip('"') if i < 3 else t
        assert got[i]["n_entities"] == 1 and secret not in got[i]["text"] and len(got[i]["text"]) == len(rows[i][1]), got[i]
    assert [got[i]["kinds"] for i in range(len(held))] == [["secret"]] * 3 + [["phone"]] * 2 + [["ip"]] * 2
    assert all(got[len(held) + i]["text"] == f"see {t} there" for i, t in enumerate(plain))


def changed(spark, texts):
    got = {r["doc_id"]: r for r in pii.replace(docs(spark, [(i, t, "", "a") for i, t in enumerate(texts)])).collect()}
    return [got[i]["text"] for i in range(len(texts))]


def test_names_keep_together_and_keep_case_gender_and_script(spark):
    one, two, three, four, five, six = changed(
        spark,
        [
            "Mr. John Smith came. Smith said that John left; SMITH, Smithson and smith.",
            "Mr. SMITH and Dr. Jane Roe, Roe again; Prof. O'Brien, O'Brien's",
            "господин Петров и госпожа Петрова, потом Петрова и Петров",
            "Κύριος Νίκος Παπάς, Παπάς",
            "\u0001 Mr. Smith \u0002\u0003\u0001\u0002\u0004 x",
            "Anna.B@Mail.com anna.b@mail.com ΑΒγ@mail.com 山田@mail.jp",
        ],
    )
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) said that (\w+) left; (\w+), Smithson and smith\.", one)
    assert m and m[2] == m[3] != "Smith" and m[1] == m[4] != "John" and m[5] == m[2].upper()
    n = re.fullmatch(r"Mr\. (\w+) and Dr\. (\w+) (\w+), (\w+) again; Prof\. (\w+), (\w+)'s", two)
    assert n and n[1] == m[2].upper() and n[3] == n[4] and n[5] == n[6] != "O" and n[2].lower() in pii._GIVEN["given_n"][0]
    c = re.fullmatch(r"господин (\w+нов) и госпожа (\w+нова), потом (\w+) и (\w+)", three)
    assert c and c[2] == c[1] + "а" == c[3] and c[4] == c[1]
    g = re.fullmatch(r"Κύριος ([\u0370-\u03ff]+) ([\u0370-\u03ff]+), (\w+)", four)
    assert g and g[2] == g[3] != "Παπάς" and g[1].lower() in pii._GIVEN["given_m"][2]
    assert re.fullmatch("\u0001 Mr\\. \\w+ \u0002\u0003\u0001\u0002\u0004 x", five) and "Smith" not in five
    a, b, u, y = six.split()
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z]@[a-z]{4}\.example", a)
    assert re.fullmatch(r"[\u0370-\u03ff]{3}@.*", u) and re.fullmatch(r"[\u4e00-\u4e7f]{2}@.*", y)


def canonical(e):
    """What makes two entities the same one, read anew from the rules."""
    if "@" in e:
        return "email", e.lower()
    if regex.fullmatch(pii.NAME, e):
        words = regex.sub(r"^\S+ ", "", e).lower().split(" ")
        return "name", words[-1]
    if regex.match(r"(?i)(token|secret|password|passwd|key)\s*[=:]", e):
        return "secret", regex.search(r"[A-Za-z0-9_/+-]+$", e)[0]
    if regex.fullmatch(pii.ACCESS_KEY, e) or ":" in e or regex.fullmatch(pii.IP, e):
        return "other", e.lower() if ":" in e else e
    kind = "phone" if regex.fullmatch(pii.PHONE, e) else "ssn" if regex.fullmatch(pii.SSN, e) else "card"
    return kind, (e[0] == "+", regex.sub(r"\D", "", e))


def test_all_kinds_against_an_independent_reading(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    make = [
        lambda: f"{word(2)}@{word(1)}.com",
        lambda: f"{word(2).title()}@{word(1)}.com",
        lambda: f"+1 {rng.randrange(200, 215)}-555-01{digits(1)}0",
        lambda: f"({rng.randrange(200, 215)}) 555-01{digits(1)}0",
        lambda: f"{digits(1)}00-00-000{digits(1)}",
        lambda: f"4000 0000 0000 00{digits(2)}",
        lambda: f"10.0.0.{rng.randrange(60)}",
        lambda: "key = " + word(1) * 14,
        lambda: f"Mr. {word(3).title()}",
        lambda: f"Mrs. Anna {word(3).title()}",
        lambda: f"AKIA{digits(2)}{'Z' * 14}",
        lambda: f"fe80:0:0:0:0:0:0:{digits(2)}",
    ]
    texts = ["¦".join(make[(i + j) % len(make)]() if j % 2 else f" gap {word(6)} " for j in range(13)) for i in range(300)]
    out = changed(spark, texts)
    there, back, real, made = {}, {}, set(), set()
    for before, after in zip(texts, out):
        a, b = before.split("¦"), after.split("¦")
        assert len(a) == len(b)
        found = [m[0] for m in regex.finditer(pii.ENTITY, before)]
        assert found == [x.strip() for x in a[1::2]]
        assert a[::2] == b[::2]  # all between the entities stays
        for x, y in zip(a[1::2], b[1::2]):
            (kind, cx), (kind_y, cy) = canonical(x), canonical(y)
            assert kind == kind_y and regex.fullmatch(pii.ENTITY, y), (x, y)
            assert there.setdefault((kind, cx), cy) == cy and back.setdefault((kind, cy), cx) == cx, (x, y)
            real.add((kind, cx))
            made.add((kind, cy))
            if kind in ("ssn", "card"):
                assert regex.sub(r"\d", "0", x) == regex.sub(r"\d", "0", y)
    assert not real & made and len(real) == len(made) > 300
