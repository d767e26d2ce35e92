"""DataFrame operators: cleaning, labelling, features, batch QC, evaluation,
linear algebra, sampling, modelling, quality checks, running totals."""
