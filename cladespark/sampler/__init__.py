"""Metropolis-coupled sampling: sequential within a chain, parallel over runs and chains."""
