"""Readers that the reader source is tested with; executors import this module."""

import time

from proofmark.sources.reader import Unavailable


class Moody:
    """Answers by what the key says; ``once`` keys fail at the first question only."""

    def __init__(self, options, bucket):
        self.asked = {}

    def read(self, key, timeout):
        self.asked[key] = self.asked.get(key, 0) + 1
        kind, first = key.split("-")[0], self.asked[key] == 1
        if kind == "slow" or (kind == "slowonce" and first):
            time.sleep(timeout + 1)
        if kind == "away" or (kind == "awayonce" and first):
            raise Unavailable("The reader is away.")
        if kind == "unknown":
            raise KeyError(key)
        if kind == "broken":
            raise ValueError("secret detail")
        return f'{{"key": "{key}"}}'
