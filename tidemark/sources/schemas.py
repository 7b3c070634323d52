"""Explicit schemas; nothing is inferred."""

OPTION_TRADES = (
    "underlying_symbol string, quote_datetime string, root string, expiration string, strike double, option_type string, open double, high double, low double, close double, "
    "trade_volume double, bid_size double, bid double, ask_size double, ask double, underlying_bid double, underlying_ask double, implied_volatility double, "
    "delta double, gamma double, theta double, vega double, rho double, open_interest double"
)
VENDOR_TRADES = "ticker string, conditions string, correction int, exchange int, price double, sip_timestamp long, size double, sequence_number long, tape int"
VENDOR_QUOTES = "ticker string, ask_exchange int, ask_price double, ask_size double, bid_exchange int, bid_price double, bid_size double, sequence_number long, sip_timestamp long, tape int"
EVENT = "kind string, ts long, underlying string, strike double, expiry string, cp_flag string, bid double, ask double, bid_sz double, ask_sz double, last_px double, last_sz double, last_side int, iv double, delta double, gamma double, theta double, vega double"
L2_MESSAGE = "channel string, events array<struct<type:string,product_id:string,updates:array<struct<side:string,price_level:string,new_quantity:string>>,trades:array<struct<product_id:string,side:string,price:string,size:string>>>>"
POSTS = "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,score:long,num_comments:long,created_utc:double,url:string,author:string,subreddit:string>>>>"
ARTICLES = "articles array<struct<title:string,description:string,url:string,publishedAt:string,source:struct<name:string>>>"
TWEETS = "data array<struct<id:string,text:string,created_at:string,public_metrics:struct<like_count:long,retweet_count:long>>>"
CHAIN = "results array<struct<details:struct<ticker:string,strike_price:double,expiration_date:string,contract_type:string>,last_quote:struct<bid:double,ask:double,bid_size:double,ask_size:double>,greeks:struct<delta:double,gamma:double,theta:double,vega:double>,implied_volatility:double>>"
