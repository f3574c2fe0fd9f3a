"""Scorers: text to scores, as columns.

``SCORERS`` maps a name to a maker of a function of a text column that gives a struct (neg, neu, pos, compound).
The lexicon scorer is an Arrow UDF over batches with a word table of our own (or the user's file) as a hash table;
the model scorer is one too, with the model loaded once per worker, and says so clearly where its runtime is missing.
Output is never labelled with a scorer that didn't run.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE_FROM, NEGATIVE_TO, NORMALISER = 0.05, -0.05, 15.0
BOOST, NEGATE, CAPITALS, BANG, MAX_BANGS = 0.293, -0.74, 0.733, 0.292, 4

#: Words of financial news with valences of our own, in halves from -3 to 3.
LEXICON = {
    "good": 2.0, "great": 3.0, "best": 3.0, "better": 1.5, "strong": 2.0, "gain": 1.5, "gains": 1.5, "profit": 2.0, "profits": 2.0, "win": 2.5, "wins": 2.5,
    "success": 2.5, "successful": 2.5, "share": 0.5, "shares": 0.5, "growth": 2.0, "boost": 1.5, "boosts": 1.5, "rally": 2.0, "surge": 2.0, "happy": 2.5,
    "confident": 2.0, "approval": 1.5, "approved": 1.5, "support": 1.0, "top": 1.0, "hope": 1.0, "opportunity": 1.5, "beat": 1.5, "upgrade": 2.0, "record": 1.0,
    "bad": -2.0, "worse": -2.5, "worst": -3.0, "weak": -1.5, "loss": -2.0, "losses": -2.0, "lose": -1.5, "lost": -1.5, "fall": -1.0, "falls": -1.0, "drop": -1.0,
    "drops": -1.0, "plunge": -2.5, "crash": -3.0, "fear": -1.5, "fears": -1.5, "risk": -1.0, "risks": -1.0, "fraud": -3.0, "crisis": -2.5, "debt": -0.5, "fail": -2.0,
    "fails": -2.0, "failure": -2.5, "cut": -1.0, "cuts": -1.0, "warning": -1.5, "warns": -1.0, "penalty": -1.5, "ban": -1.5, "trash": -2.0, "worthless": -3.0, "disgusting": -2.5, "downgrade": -2.0,
}
BOOSTERS = {"very": BOOST, "extremely": BOOST, "highly": BOOST, "hugely": BOOST, "most": BOOST, "sharply": BOOST, "slightly": -BOOST, "somewhat": -BOOST, "marginally": -BOOST, "barely": -BOOST}
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")  # other than letters and digits
NEGATIONS = ("not", "no", "never", "none", "without", "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "won't", "wasn't")


def load_lexicon(spark: SparkSession, path: str) -> dict[str, float]:
    """Words and mean valences of a tab-separated lexicon file; a missing file is an error."""
    rows = spark.read.schema("word string, valence double").option("sep", "\t").option("quote", "").csv(path)
    return {r.word: r.valence for r in rows.filter("word is not null and valence is not null").collect()}


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))


def _half_up(x: float, places: int) -> float:
    scale = 10.0**places
    return math.copysign(math.floor(abs(x) * scale + 0.5) / scale, x) if x else 0.0


def score_words(text: str | None, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
    """(neg, neu, pos, compound): valences with boosters, negation in the three words before, capitals and exclamation marks."""
    bare = [_EDGES.sub("", w) for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    low = [w.lower() for w in bare]
    shouted = [len(w) > 1 and w.upper() == w and w.lower() != w for w in bare]
    mixed = any(shouted) and not all(s or len(w) <= 1 for s, w in zip(shouted, bare, strict=True))
    total = plus = minus = 0.0
    plain = 0
    for i, w in enumerate(low):
        v = lexicon.get(w, 0.0)
        if not v:
            plain += 1
            continue
        sign = math.copysign(1.0, v)
        if mixed and shouted[i]:
            v += sign * CAPITALS
        near = [low[i - k] if i >= k else "" for k in (1, 2, 3)]
        for word, fade in zip(near, (1.0, 0.95, 0.9), strict=True):
            v += sign * fade * BOOSTERS.get(word, 0.0)
        if any(word in NEGATIONS for word in near):
            v *= NEGATE
        total += v
        plus, minus = plus + (v + 1 if v > 0 else 0.0), minus + (1 - v if v < 0 else 0.0)
        plain += v == 0
    bangs = min((text or "").count("!"), MAX_BANGS) * BANG
    total += math.copysign(bangs, total) if total else 0.0
    plus, minus = plus + (bangs if plus > minus else 0.0), minus + (bangs if minus > plus else 0.0)
    whole = plus + minus + plain
    share = lambda x: _half_up(x / whole, 3) if whole else 0.0
    compound = max(-1.0, min(1.0, _half_up(total / math.sqrt(total * total + NORMALISER), 4)))
    return share(minus), share(plain), share(plus), compound


def lexicon_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Struct (neg, neu, pos, compound) of :func:`score_words`, in Arrow batches."""
    words = lexicon or LEXICON

    @F.pandas_udf("neg double, neu double, pos double, compound double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score_words(t, words) for t in texts], columns=["neg", "neu", "pos", "compound"])

    return run(text)


def token_valence(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Normalised sum of the word valences alone, with no rules: s / sqrt(s^2 + 15)."""
    table = _table(lexicon or LEXICON)
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    s = F.aggregate(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return s / F.sqrt(s * s + NORMALISER)


def label(compound: Column) -> Column:
    return F.when(compound >= POSITIVE_FROM, "positive").when(compound <= NEGATIVE_TO, "negative").otherwise("neutral")


def label_of_shares(positive: Column, negative: Column, neutral: Column) -> Column:
    """Largest share; of equals the first of positive, negative, neutral."""
    return F.when((positive >= negative) & (positive >= neutral), "positive").when(negative >= neutral, "negative").otherwise("neutral")


class ScorerUnavailable(RuntimeError):
    """The scorer's runtime or model isn't installed."""


def model_score(predict: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]]) -> Callable[[Column], Column]:
    """A scorer from ``predict``, which loads a model once per worker and returns a function of a batch of texts to (positive, negative, neutral)."""
    @F.pandas_udf("positive double, negative double, neutral double")
    def shares(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = predict()
        for texts in batches:
            yield pd.DataFrame(run(texts.fillna("").tolist()), columns=["positive", "negative", "neutral"])

    def score(text: Column) -> Column:
        got = shares(text)
        return F.struct(got.negative.alias("neg"), got.neutral.alias("neu"), got.positive.alias("pos"), (got.positive - got.negative).alias("compound"))

    return score


def transformer(model: str) -> Callable[[Column], Column]:
    """Scorer of a three-class sequence classifier on local files; raises where torch or transformers is missing."""
    import importlib.util

    if missing := [m for m in ("torch", "transformers") if importlib.util.find_spec(m) is None]:
        raise ScorerUnavailable(f"the model scorer needs {' and '.join(missing)}")

    def load():
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tokenizer, net = AutoTokenizer.from_pretrained(model), AutoModelForSequenceClassification.from_pretrained(model).eval()
        at = {v.lower(): k for k, v in net.config.id2label.items()}

        def run(texts: list[str]) -> list[tuple[float, float, float]]:
            out = []
            with torch.no_grad():
                for i in range(0, len(texts), 32):
                    p = torch.softmax(net(**tokenizer(texts[i : i + 32], padding=True, truncation=True, return_tensors="pt")).logits, dim=-1)
                    out += [(float(r[at["positive"]]), float(r[at["negative"]]), float(r[at["neutral"]])) for r in p]
            return out

        return run

    return model_score(load)


def summed_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """The same struct from the plain sum of valences: shares are those of the sign."""
    c = F.round(token_valence(text, lexicon), 4)
    return F.struct((c < 0).cast("double").alias("neg"), (c == 0).cast("double").alias("neu"), (c > 0).cast("double").alias("pos"), c.alias("compound"))


#: Name to a maker of the scorer from its options: ``lexicon`` (a word table) and ``path`` (a model's local files).
SCORERS: dict[str, Callable[[dict[str, float] | None, str | None], Callable[[Column], Column]]] = {
    "lexicon": lambda lexicon, path: lambda t: lexicon_score(t, lexicon),
    "sum": lambda lexicon, path: lambda t: summed_score(t, lexicon),
    "model": lambda lexicon, path: transformer(path),
}


def scorer(name: str, lexicon: dict[str, float] | None = None, path: str | None = None) -> Callable[[Column], Column]:
    if name not in SCORERS:
        raise ScorerUnavailable(f"no scorer {name!r} is registered; there are: {', '.join(sorted(SCORERS))}")
    if name == "model" and not path:
        raise ScorerUnavailable("the model scorer needs the path of a model")
    return SCORERS[name](lexicon, path)


def score(df: DataFrame, name: str = "lexicon", text: str = "title", lexicon: dict[str, float] | None = None, path: str | None = None) -> DataFrame:
    """``df`` with neg, neu, pos, compound, label and the name of the scorer that ran."""
    out = df.withColumn("_s", scorer(name, lexicon, path)(F.col(text)))
    out = out.withColumns({k: F.col(f"_s.{k}") for k in ("neg", "neu", "pos", "compound")}).drop("_s")
    return out.withColumns({"label": label(F.col("compound")), "model": F.lit(name)})
