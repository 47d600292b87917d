def price_of(name):
    return len(name)


def tax(x):
    return price_of(x) * 2


def read(path):
    return load(path)


def load(path):
    return open(path).read()
