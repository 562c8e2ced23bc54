"""The engine has no streaming operators: every "daily" dataset is a batch group by date.

The package is kept so that the layout is complete; nothing is implemented here on purpose.
"""
