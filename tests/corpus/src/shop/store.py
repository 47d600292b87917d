"""Stock of a shop."""
import functools
from . import pricing
from .pricing import price_of as cost, tax


class Store:
    """Holds items."""

    def __init__(self, items):
        self.items = dict(items)

    @functools.lru_cache
    def total(self):
        """Sum of all prices."""
        return sum(cost(name) for name in self.items) + self.count()

    def count(self):
        return len(self.items)

    async def reload(self, loader):
        def inner(x):
            return tax(x)

        self.items = await loader(inner)


def parseConfigFile(path):
    return Store(load(path))


def load(path):
    return pricing.read(path)
