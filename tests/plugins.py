"""An encoder and a reranker of one's own, named as module:Class in the settings."""

import numpy as np


class FirstLetters:
    """Texts are alike if their words begin with the same letters."""

    dim = 26

    def encode(self, texts):
        dense, sparse = np.zeros((len(texts), self.dim)), []
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if "a" <= w[0] <= "z":
                    dense[i, ord(w[0]) - 97] += 1
            sparse.append({j: float(x) for j, x in enumerate(dense[i]) if x})
        return dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1), sparse


class Shortest:
    def __init__(self, bonus=0.0):
        self.bonus = bonus

    def score(self, query, passages):
        return [self.bonus - len(p) for p in passages]
