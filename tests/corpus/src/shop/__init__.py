from .store import Store
