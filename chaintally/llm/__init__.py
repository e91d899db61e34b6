"""Operators for preparing training text at scale, one module each.

Their functions run on executors that need not have this package installed: every module
is registered to travel inside the tasks that use it.
"""
