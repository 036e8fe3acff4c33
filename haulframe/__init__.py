"""Field-survey and landings analytics as DataFrame-to-DataFrame functions.

``functions``  column expressions (null rules, text, dates, small distributions)
``sources``    readers, writers and the shared scratch tables
``operators``  relational, ordered and statistical building blocks
``plans``      the analyses a survey or landings analyst asks for
"""
