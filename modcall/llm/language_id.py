"""Language identification by a small bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents.
It labels every byte of a text; the probabilities of all positions are averaged over the document. Texts
run in segments of fixed length, all of them and whole, so that many go through a step together.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, raw, slices, without

#: Documents of a language that the sample holds, passages taken from each, and their characters.
PER_LANGUAGE, PASSAGES, PASSAGE = 256, 4, 96
#: Units in each direction, bytes of a segment, and training steps, sequences a step and rate.
UNITS, SEGMENT, STEPS, ROWS, RATE = 8, 128, 240, 128, 0.03
#: Documents of the sample in all; beyond TOTAL / PER_LANGUAGE languages each has fewer.
TOTAL = 64 * PER_LANGUAGE


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GRU:
    """One direction. table: gate inputs of each byte (3u x 256); u: recurrent weights (3u x units)."""

    def __init__(self, units: int, rng):
        self.units = units
        self.table = rng.normal(0, 0.3, (3 * units, 256)).astype(np.float32)
        self.table[:units] += 1.0  # start with a long memory
        self.u = rng.normal(0, units**-0.5, (3 * units, units)).astype(np.float32)

    def forward(self, x, keep: bool = False):
        """States (steps, units, rows) of byte columns x (steps, rows); keep: also what backward needs."""
        n = self.units
        h = np.zeros((n, x.shape[1]), np.float32)
        out, kept = np.empty((len(x), n, x.shape[1]), np.float32), []
        for t in range(len(x)):
            a = np.take(self.table, x[t], axis=1, mode="clip")
            b = self.u @ h
            gates = _sigmoid(a[: 2 * n] + b[: 2 * n])
            z, r = gates[:n], gates[n:]
            new = np.tanh(a[2 * n :] + r * b[2 * n :])
            if keep:
                kept.append((h, z, r, new, b[2 * n :]))
            h = new + z * (h - new)
            out[t] = h
        return (out, kept) if keep else out

    def backward(self, x, kept, grad):
        """Gradients of table and u, by backpropagation through time; grad: of the states."""
        n = self.units
        table, u = np.zeros_like(self.table), np.zeros_like(self.u)
        later = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, new, b = kept[t]
            g = grad[t] + later
            dn = g * (1 - z) * (1 - new**2)
            dz = g * (h - new) * z * (1 - z)
            dr = dn * b * r * (1 - r)
            da = np.concatenate([dz, dr, dn])
            db = np.concatenate([dz, dr, dn * r])
            for gate in range(3 * n):
                table[gate] += np.bincount(x[t], da[gate], 256)
            u += db @ h.T
            later = g * z + self.u.T @ db
        return table, u


class Tagger:
    """Both directions and the output layer; labels are the sorted learned languages."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.parts = labels, [GRU(UNITS, rng), GRU(UNITS, rng)]
        self.v = rng.normal(0, 0.1, (len(labels), 2 * UNITS)).astype(np.float32)
        self.c = np.zeros((len(labels), 1), np.float32)

    def weights(self):
        return [self.parts[0].table, self.parts[0].u, self.parts[1].table, self.parts[1].u, self.v, self.c]

    def probabilities(self, x):
        """Label probabilities (steps, labels, rows) of byte columns x (steps, rows)."""
        logits = self.v[:, :UNITS] @ self.parts[0].forward(x)
        logits += self.v[:, UNITS:] @ self.parts[1].forward(x[::-1])[::-1]
        logits += self.c
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=1, keepdims=True)

    def gradients(self, x, y):
        """Gradients of the mean cross entropy of all positions, y being the label of each row."""
        fore, kept = self.parts[0].forward(x, True)
        back, kept_back = self.parts[1].forward(x[::-1], True)
        h = np.concatenate([fore, back[::-1]], axis=1)
        p = self.v @ h + self.c
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(len(y))] -= 1
        p /= x.size
        dv, dc = np.einsum("tlb,thb->lh", p, h), p.sum((0, 2))[:, None]
        dh = self.v.T @ p
        return [*self.parts[0].backward(x, kept, dh[:, :UNITS]), *self.parts[1].backward(x[::-1], kept_back, dh[::-1, UNITS:]), dv, dc]

    def fit(self, texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11):
        """Adam on random segments, languages in equal parts."""
        rng = np.random.default_rng(seed)
        own = {k: [t for t, lab in zip(texts, labels, strict=True) if lab == k and t] for k in self.labels}
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights()]
        for step in range(1, steps + 1):
            y = (np.arange(ROWS) + (step * ROWS if len(self.labels) > ROWS else 0)) % len(self.labels)
            x = np.zeros((ROWS, SEGMENT // 2), np.uint8)
            for i, k in enumerate(y):
                some = own[self.labels[k]]
                t = some[rng.integers(len(some))]
                at = int(rng.integers(max(1, len(t) - SEGMENT // 2 + 1)))
                cut = np.frombuffer(t[at : at + SEGMENT // 2], np.uint8)
                x[i] = np.resize(cut, SEGMENT // 2)
            rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
            for w, g, m in zip(self.weights(), self.gradients(np.ascontiguousarray(x.T), y), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                w -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]):
        """Mean label probabilities (documents, labels) over all bytes of each text; no bytes: zeros."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        many = -(-size // SEGMENT)
        total = np.zeros((len(texts), len(self.labels)))
        if not many.sum():
            return total
        flat = np.frombuffer(b"".join(t + b"\0" * (-len(t) % SEGMENT) for t in texts), np.uint8).reshape(-1, SEGMENT)
        doc = np.repeat(np.arange(len(texts)), many)
        first = np.cumsum(many) - many
        valid = np.minimum(np.repeat(size, many) - (np.arange(len(doc)) - np.repeat(first, many)) * SEGMENT, SEGMENT)
        for a in range(0, len(flat), 4096):
            x = np.ascontiguousarray(flat[a : a + 4096].T)
            p = self.probabilities(x)
            short = np.flatnonzero(valid[a : a + 4096] < SEGMENT)
            for i in short:
                p[valid[a + i] :, :, i] = 0
            sums = p.sum(axis=0, dtype=np.float64)
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(doc[a : a + 4096], sums[k], len(texts))
        return total / np.maximum(size, 1)[:, None]


def _sample(docs, held):
    """At most PER_LANGUAGE documents of each language, by a hash of their id, and TOTAL in all, the languages in
    turn; PASSAGES windows of each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held).select("doc_id", "lang")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.withColumn("__n", turn).where(F.col("__n") <= PER_LANGUAGE).orderBy("__n", "lang", "doc_id").limit(TOTAL).select("doc_id", "lang").distinct()
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), F.length("text") - PASSAGE)).cast("int") + 1 for i in range(PASSAGES)]
    passages = F.array(*[F.substring("text", s, PASSAGE) for s in starts])
    rows = docs.where(~held).join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", F.explode(passages).alias("part"))
    return rows.where(F.col("part").rlike(r"\p{L}")).orderBy("lang", "doc_id", "part").collect()


def _predict(model, place: int):
    def run(batches):
        tagger = model.value
        for batch in batches:
            texts, label, score = raw(batch.column(place)), [], []
            letters = pa.compute.fill_null(pa.compute.match_substring_regex(batch.column(place), r"\p{L}"), False).to_pylist()
            for a, b in slices(texts):
                p = tagger.documents([t if t and fine else b"" for t, fine in zip(texts[a:b], letters[a:b], strict=True)])
                for row, fine in zip(p, letters[a:b], strict=True):
                    best = int(row.argmax()) if fine and tagger.labels else -1
                    label.append(tagger.labels[best] if best >= 0 else "und")
                    score.append(min(1.0, float(row[best])) if best >= 0 else 0.0)
            yield pa.record_batch([*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify_language(docs, model=None):
    """docs with held_out, lang_pred and score (the mean probability of the language over all bytes).

    The model learns from text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0
    (null doc_id: neither learned from nor held out), at most PER_LANGUAGE of each language and TOTAL in
    all. Text that is null or has no letter: 'und', 0.0; so is every text where there is nothing to learn from. Ties go to
    the first language in order. Repeated rows repeat; other columns pass, those named like a result are
    replaced. model: a fitted Tagger to use instead.
    """
    docs = without(docs, "held_out", "lang_pred", "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    if model is None:
        sample = _sample(docs, held)
        labels = sorted({r["lang"] for r in sample})
        model = Tagger(labels)
        if labels:
            model.fit([r["part"].encode() for r in sample], [r["lang"] for r in sample])
    place = [c.lower() for c in docs.columns].index("text")
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]).add("lang_pred", "string").add("score", "double")
    got = docs.mapInArrow(lean(_predict(docs.sparkSession.sparkContext.broadcast(model), place)), shape)
    return got.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def op7_language_id(spark, sf_dir):
    """Per document: whether it is held out, the predicted language and its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", "held_out", "lang_pred", "score")
