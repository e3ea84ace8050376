"""duecheck: find revenue that a contract allows but no invoice collected.

Every public function takes DataFrames and returns a DataFrame; see README.md.
"""
