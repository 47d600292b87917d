def windows():
    return "caf�"
