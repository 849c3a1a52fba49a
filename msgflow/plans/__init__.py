"""Plans that combine operators: training, scoring and answering messages."""
