"""Training-data operators: chat formatting, sharding, quality rules, fixity audits, tokenisation,
license scans, language-model scores, near-duplicate removal and benchmark decontamination.

Nothing outside this subpackage imports it; ``queries`` registers one query per operator.
"""
