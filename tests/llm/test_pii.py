"""Added kinds of personal data, and time on long texts."""

import random
import time

from measured.llm import pii

from . import cases


def kinds(x):
    return [(k, x[a:b]) for k, a, b in pii.found(x)]


def test_secrets():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for x in (f'token = "{key}" and', f"API_KEY={key}", f"password: '{key}'", f"access-key:{key}"):
        assert kinds(x) == [("secret", key)], x
    for x in (f"sum = {key}", "token = aaaaaaaaaaaaaaaaaaaa1111", "token = wordswithoutanydigitinthem", "token = 12ab", f"tokens {key}"):
        assert kinds(x) == [], x
    x = f"a token = {key}."
    assert pii.redact(x, pii.found(x)) == "a token = [SECRET]."


def test_time_grows_with_the_text():
    r = random.Random(1)
    line = lambda: f"{r.choice(['Ann', 'Bo'])} +1 956 555 {r.randrange(10**4):04d} a{r.randrange(99)}@b.org 4041 8949 7460 {r.randrange(10**4):04d} 10.0.0.{r.randrange(300)} token = {r.randbytes(20).hex()}"
    took = []
    for n in (2_000, 16_000):
        x = "\n".join(line() for _ in range(n))
        began = time.process_time()
        found = pii.found(x)
        pii.redact(x, found)
        took.append(time.process_time() - began)
        assert sum(k == "email" for k, *_ in found) == n
    assert took[1] < 20 * took[0] + 0.5


def test_pii_of_no_rows_and_clashing_columns(spark):
    assert pii.digests(cases.empty(spark)).count() == 0 and pii.redacted(cases.empty(spark)).count() == 0
    df = cases.documents(spark, True)
    assert pii.redacted(df).columns == df.columns and pii.redacted(df).count() == len(cases.rows())
