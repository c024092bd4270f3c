"""Operators for training-data work on list records and texts; nothing else in the package imports this."""
