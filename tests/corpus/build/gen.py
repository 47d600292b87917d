def generated():
    pass
